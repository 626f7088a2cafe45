"""Embedding documents and query texts of jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as X
from matchloom.functions.rows import explode_rows, inline_rows, settle
from matchloom.operators.parsing import all_bullets
from matchloom.operators.skills import validated_source
from matchloom import rules as R
from matchloom.sources.answers import answered_once

KEYS = ("tenantId", "jobId")


def _truthy(items: Column) -> Column:
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def make_chunk(header: Column | str, items: Column | str) -> Column:
    """Header, then the non-empty items, one per line, white space cut at both ends."""
    body = F.array_join(_truthy(X.col(items)), "\n")
    return X.strip(F.concat(F.coalesce(X.col(header), F.lit("")), F.lit("\n"), body))


def _id(*parts: Column) -> Column:
    return F.concat_ws("#", F.col("tenantId"), F.col("jobId"), *parts)


def _metadata(kind: str, **extra: Column) -> Column:
    pairs = [F.lit("tenantId"), F.col("tenantId"), F.lit("jobId"), F.col("jobId"), F.lit("type"), F.lit(kind)]
    for name, value in extra.items():
        pairs += [F.lit(name), value]
    return F.create_map(*[p.cast("string") for p in pairs])


def build_embedding_docs(jobs: DataFrame, validated: DataFrame | None = None, skills: DataFrame | None = None) -> DataFrame:
    """All texts of a job that get a vector: (tenantId, jobId, id, text, metadata).

    ``jobs``: ``job``, ``resume``. ``validated``: ``idx``, ``resume``. ``skills``: output of
    ``rank_skills``. The four shapes are four narrow selects put together by a union.
    """
    cols = ("tenantId", "jobId", "id", "text", "metadata")
    jd = jobs.select(
        *KEYS,
        _id(F.lit("jd")).alias("id"),
        make_chunk("job.summary", F.concat("job.requirements", "job.responsibilities")).alias("text"),
        _metadata("job-description", title=F.coalesce("job.meta.title", F.lit("unknown"))).alias("metadata"),
    )
    roles = explode_rows(jobs, KEYS, "resume.experience", "role", "n")
    base = roles.select(
        *KEYS,
        _id(F.lit("base"), F.col("n").cast("string")).alias("id"),
        make_chunk("role.title", "role.achievements").alias("text"),
        _metadata(
            "base-experience",
            role=F.coalesce("role.title", F.lit("")),
            company=F.coalesce("role.company", F.lit("")),
        ).alias("metadata"),
    )
    parts = [jd, base]
    if validated is not None:
        parts.append(
            validated.select(
                *KEYS,
                _id(F.lit("validated"), F.col("idx").cast("string")).alias("id"),
                make_chunk("resume.summary", all_bullets("resume")).alias("text"),
                _metadata(
                    "validated-resume",
                    sourceKey=validated_source("resume", "idx"),
                    outcome=F.coalesce("resume.meta.outcome", F.lit(R.DEFAULT_OUTCOME)),
                ).alias("metadata"),
            )
        )
    if skills is not None:
        parts.append(
            skills.select(
                *KEYS,
                _id(F.lit("skill"), F.col("skill_no").cast("string")).alias("id"),
                F.col("skill").alias("text"),
                _metadata("skill", sources=F.array_join("sources", ",")).alias("metadata"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*cols)


def _ranked_skills(pairs: str) -> Column:
    """Distinct skills of (skill, source) pairs: most frequent first, then by name, with their sorted sources."""

    def counted(skill):
        own = F.filter(pairs, lambda p: p["skill"] == skill)
        sources = F.sort_array(F.array_distinct(F.transform(own, lambda p: p["source"])))
        return F.struct((-F.size(own)).alias("order"), skill.alias("skill"), sources.alias("sources"))

    return F.array_sort(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["skill"])), counted))


def job_documents(rows: DataFrame) -> DataFrame:
    """The texts of ``build_embedding_docs`` from one row per job: ``job``, ``resume`` and ``validated``, an array of
    resumes. All four shapes are one array of the row, so nothing is shuffled and the row is read once."""

    def source(resume, at):
        return F.coalesce(resume["meta"]["sourceKey"], F.concat(F.lit("validated-"), at.cast("string")))

    lists = F.concat(
        F.array(
            F.struct(F.lit("job").alias("source"), F.col("job.skills").alias("skills")),
            F.struct(F.lit("base").alias("source"), F.col("resume.skills").alias("skills")),
        ),
        F.transform("validated", lambda r, i: F.struct(source(r, i).alias("source"), r["skills"].alias("skills"))),
    )

    def pairs(entry):
        skills = F.transform(F.coalesce(entry["skills"], F.array().cast("array<string>")), lambda s: X.strip(F.lower(s)))
        return F.transform(F.filter(skills, lambda s: s != ""), lambda s: F.struct(s.alias("skill"), entry["source"].alias("source")))

    def document(parts, text, metadata):
        return F.struct(_id(*parts).alias("id"), text.alias("text"), metadata.alias("metadata"))

    rows = settle(rows, _lists=lists)
    rows = settle(rows.withColumn("_pairs", F.flatten(F.transform("_lists", pairs))).drop("_lists"), _pairs=F.col("_pairs"))
    jd = document(
        [F.lit("jd")], make_chunk("job.summary", F.concat("job.requirements", "job.responsibilities")),
        _metadata("job-description", title=F.coalesce("job.meta.title", F.lit("unknown"))),
    )
    base = F.transform(
        "resume.experience",
        lambda role, n: document(
            [F.lit("base"), n.cast("string")], make_chunk(role["title"], role["achievements"]),
            _metadata("base-experience", role=F.coalesce(role["title"], F.lit("")), company=F.coalesce(role["company"], F.lit(""))),
        ),
    )
    validated = F.transform(
        "validated",
        lambda r, i: document(
            [F.lit("validated"), i.cast("string")], make_chunk(r["summary"], all_bullets(r)),
            _metadata("validated-resume", sourceKey=source(r, i), outcome=F.coalesce(r["meta"]["outcome"], F.lit(R.DEFAULT_OUTCOME))),
        ),
    )
    skills = F.transform(
        _ranked_skills("_pairs"),
        lambda s, n: document([F.lit("skill"), n.cast("string")], s["skill"], _metadata("skill", sources=F.array_join(s["sources"], ","))),
    )
    none = F.array().cast("array<struct<id:string,text:string,metadata:map<string,string>>>")
    return inline_rows(rows, KEYS, F.concat(F.array(jd), F.coalesce(base, none), F.coalesce(validated, none), skills))


def build_queries(jobs: DataFrame) -> DataFrame:
    """Three query texts per job: summary, requirements, all achievements."""
    empty = F.lit("")
    texts = F.array(
        F.coalesce("job.summary", empty),
        F.coalesce(F.array_join("job.requirements", "\n"), empty),
        F.coalesce(F.array_join(all_bullets("resume"), "\n"), empty),
    )
    return explode_rows(jobs, KEYS, texts, "text", "query_no")


EMBEDDING_DIMENSIONS = 64


def hashing_embedder(df: DataFrame, text: str, out: str) -> DataFrame:
    """Built-in stand-in for a model: hashed token counts, scaled to length 1 (JVM only)."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    tokens = df.withColumn("_tokens", X.tokens(text))
    tf = HashingTF(numFeatures=EMBEDDING_DIMENSIONS, inputCol="_tokens", outputCol="_tf").transform(tokens)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(tf)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_unit")


def embed(
    df: DataFrame,
    model: Callable[[Column], Column] | None = None,
    text: str = "text",
    out: str = "embedding",
    drop_empty: bool = False,
    store: str | None = None,
    batches: int = 1,
) -> DataFrame:
    """Add a vector per text. ``model`` is a column function, for example a pandas UDF
    (string -> array<float>). A text without a vector is an error.

    ``drop_empty=True`` (queries) leaves out empty texts before the model sees them. With ``store``, a folder, the
    model is asked once per distinct text, and its vectors are kept there for later runs (``sources.answers``).
    """
    if drop_empty:
        df = df.where(F.col(text) != "")
    if model is None:
        return hashing_embedder(df, text, out)
    if store is None:
        staged = df.withColumn("_vector", model(F.col(text)).cast("array<float>"))
    else:
        staged = answered_once(df, [text], model, "_vector", store, "array<float>", batches)
    missing = F.col("_vector").isNull() | (F.size("_vector") == 0)
    return staged.withColumn(
        out, F.when(missing, F.raise_error(F.lit("embedding model returned no vector")).cast("array<float>")).otherwise(F.col("_vector"))
    ).drop("_vector")


def embedding_summary(docs: DataFrame, index: str, collection: str) -> DataFrame:
    """Per job: sorted vector ids, their count, and where they live."""
    return docs.groupBy(*KEYS).agg(
        F.sort_array(F.collect_list("id")).alias("vectorIds"),
        F.count(F.lit(1)).alias("documentCount"),
        F.lit(index).alias("index"),
        F.lit(collection).alias("collection"),
        F.current_timestamp().alias("timestamp"),
    )
