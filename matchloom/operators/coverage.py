"""Coverage of targets, keywords and evidence.

Two forms of each operator. A job's own lists sit in one row, so the row form is a
projection and never shuffles. The corpus form compares tables under any key (all
documents of a source, say) by equi joins on tokens or by ``contained``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as X
from matchloom.functions.rows import explode_rows, settle
from matchloom.operators.matching import contained
from matchloom.operators.parsing import all_bullets

_STRINGS = "array<string>"


def _list(c: Column | str) -> Column:
    return F.coalesce(X.col(c), F.array().cast(_STRINGS))


def score(hits: Column, total: Column) -> Column:
    """Share of hits to 3 digits; nothing to cover counts as covered."""
    return F.when(total == 0, F.lit(1.0)).otherwise(F.round(hits / total, 3))


# --- retrieved chunks against a job description ---------------------------

def add_chunk_coverage(df: DataFrame, chunk_texts: Column, job: str = "job", out: str = "coverage") -> DataFrame:
    """Add the share of requirements, responsibilities and skills found in any chunk, and their mean.

    Without chunks the three shares are 0 and the mean is null. The chunks of a row are
    joined once (by a character no item holds), so each item costs one search.
    """
    names = ("requirements", "responsibilities", "skills")
    texts = F.coalesce(chunk_texts, F.array().cast(_STRINGS))
    staged = settle(df, _hay=F.lower(X.joined(texts)), _chunks=F.size(texts), **{job: F.col(job)})

    def share(items: Column) -> Column:
        hits = F.size(F.filter(_list(items), lambda i: F.contains(F.col("_hay"), F.lower(i))))
        return F.when(F.col("_chunks") == 0, F.lit(0.0)).otherwise(score(hits, F.size(_list(items))))

    staged = settle(staged, **{f"_{n}": share(F.col(f"{job}.{n}")) for n in names})
    total = F.col("_requirements") + F.col("_responsibilities") + F.col("_skills")
    mean = F.when(F.col("_chunks") > 0, F.round(total / 3, 3))
    packed = F.struct(*[F.col(f"_{n}").alias(n) for n in names], mean.alias("mean"))
    return staged.withColumn(out, packed).drop("_hay", "_chunks", *[f"_{n}" for n in names])


def substring_coverage(
    items: DataFrame,
    texts: DataFrame,
    keys: Sequence[str],
    item_id: str = "item_id",
    item: str = "text",
    text_id: str = "text_id",
    text: str = "text",
    force_index: bool = False,
) -> DataFrame:
    """Corpus form: per key the number of items and of items contained in any text of the key."""
    keys = list(keys)
    needles = items.select(*keys, F.col(item_id).alias("needle_id"), F.lower(item).alias("needle"))
    bodies = texts.select(*keys, F.col(text_id).alias("text_id"), F.lower(text).alias("text"))
    found = contained(bodies, needles, keys, force_index=force_index).withColumn("hit", F.lit(1))
    return (
        items.select(*keys, F.col(item_id).alias("needle_id"))
        .join(found, [*keys, "needle_id"], "left")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("hits"))
        .withColumn("score", score(F.col("hits"), F.col("total")))
    )


# --- tokens ---------------------------------------------------------------

def jd_targets(job: Column | str) -> Column:
    """Requirements, responsibilities, skills, then name and indicators of each competency."""
    job = X.col(job)
    competencies = F.flatten(
        F.transform(
            F.coalesce(job["competencies"], F.array().cast("array<struct<name:string,priority:int,evidenceIndicators:array<string>>>")),
            lambda c: F.filter(
                F.concat(F.array(c["name"]), _list(c["evidenceIndicators"])), lambda x: x.isNotNull() & (x != "")
            ),
        )
    )
    return F.concat(_list(job["requirements"]), _list(job["responsibilities"]), _list(job["skills"]), competencies)


def jd_keywords(job: Column | str) -> Column:
    """Skills, keywords and evidence indicators; blank ones dropped, repeats kept."""
    job = X.col(job)
    indicators = F.flatten(
        F.transform(
            F.coalesce(job["competencies"], F.array().cast("array<struct<name:string,priority:int,evidenceIndicators:array<string>>>")),
            lambda c: _list(c["evidenceIndicators"]),
        )
    )
    words = F.concat(_list(job["skills"]), _list(job["keywords"]), indicators)
    return F.filter(words, lambda w: w.isNotNull() & (X.strip(w) != ""))


def resume_text(resume: Column | str) -> Column:
    """Summary, achievements, skills and projects, for tokenising."""
    resume = X.col(resume)
    projects = F.flatten(
        F.transform(
            F.coalesce(resume["projects"], F.array().cast("array<struct<name:string,description:string>>")),
            lambda p: F.array(p["name"], p["description"]),
        )
    )
    return F.concat_ws("\n", resume["summary"], all_bullets(resume), _list(resume["skills"]), projects)


def with_tokens(items: str) -> Column:
    """Each item of an array (the name of a settled column) with its tokens; all of a row are normalised in one pass."""
    folded = F.split(X.token_text(X.joined(F.col(items))), X.JOINT)
    pairs = F.zip_with(items, folded, lambda i, t: F.struct(i.alias("item"), X.split_tokens(t).alias("tokens")))
    return F.slice(pairs, F.lit(1), F.size(items))  # no items give one empty text


def missing_targets(targets: Column | str, have: str) -> Column:
    """Targets (``with_tokens``, in order) with no token, or with one that does not stand between blanks in ``have``.

    ``have`` is the name of a settled column: the token text of a resume, blanks around it.
    """

    def uncovered(target):
        known = F.forall(target["tokens"], lambda t: F.contains(F.col(have), F.concat(F.lit(" "), t, F.lit(" "))))
        return (F.size(target["tokens"]) == 0) | ~known

    return F.transform(F.filter(X.col(targets), uncovered), lambda t: t["item"])


def token_coverage(
    targets: DataFrame,
    texts: DataFrame,
    keys: Sequence[str],
    target_id: str = "target_id",
    target: str = "text",
    text: str = "text",
) -> DataFrame:
    """Corpus form: one row per (keys, target) with its token count and its hits.

    A target is covered when it has tokens and each is a token of some text of the key.
    Tokens are made distinct per text inside the row and per key on the map side, so neither a
    frequent token nor a large key sends its repeats through the shuffle.
    """
    keys = list(keys)
    have = explode_rows(texts, keys, X.tokens(text), "token").distinct().withColumn("hit", F.lit(1))
    want = targets.select(*keys, F.col(target_id).alias("target_id"), F.explode_outer(X.tokens(target)).alias("token"))
    return (
        want.join(have, [*keys, "token"], "left")
        .groupBy(*keys, "target_id")
        .agg(F.count("token").alias("n_tokens"), F.count("hit").alias("n_hits"))
        .withColumn("covered", (F.col("n_tokens") > 0) & (F.col("n_hits") == F.col("n_tokens")))
    )


def coverage_scores(covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits, total and score per key from the rows of :func:`token_coverage`."""
    return (
        covered.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("covered").alias("hits"))
        .withColumn("score", score(F.col("hits"), F.col("total")))
    )


# --- evidence -------------------------------------------------------------

def job_evidence(job: Column | str) -> Column:
    """Every text of a job description, as an array."""
    job = X.col(job)
    meta = job["meta"]
    fields = F.array(
        meta["title"], meta["industry"], meta["location"], meta["source"], job["summary"], job["rawText"]
    )
    return F.array_compact(F.concat(fields, jd_targets(job), _list(job["keywords"])))


def bullet_needle(bullet: Column, chars: int | None = None) -> Column:
    """What must occur in the evidence: the lower-cased bullet, or only its first ``chars`` characters
    (``rules.EVIDENCE_CHARS`` to match reports made with that limit)."""
    return F.lower(bullet) if chars is None else F.left(F.lower(bullet), F.lit(chars))


def evidence_text(job: Column | str, chunk_texts: Column) -> Column:
    """Chunks and job description of a row, lower-cased and joined."""
    return F.lower(X.joined(F.concat(_list(chunk_texts), job_evidence(job))))


def unsupported_bullets(bullets: str, evidence: str, chars: int | None = None) -> Column:
    """Row form: achievements found nowhere in the evidence (names of settled columns)."""
    return F.filter(F.col(bullets), lambda b: ~F.contains(F.col(evidence), bullet_needle(b, chars)))


def unsupported(
    bullets: DataFrame,
    evidence: DataFrame,
    keys: Sequence[str] = (),
    bullet_id: str = "bullet_id",
    text_id: str = "text_id",
    force_index: bool = False,
    chars: int | None = None,
) -> DataFrame:
    """Corpus form: bullets (keys, bullet_id, text) found in no evidence text of their key."""
    needles = bullets.select(*keys, F.col(bullet_id).alias("needle_id"), bullet_needle(F.col("text"), chars).alias("needle"))
    bodies = evidence.select(*keys, F.col(text_id).alias("text_id"), F.lower("text").alias("text"))
    found = contained(bodies, needles, keys, force_index=force_index).withColumnRenamed("needle_id", bullet_id)
    return bullets.join(found, [*keys, bullet_id], "left_anti")
