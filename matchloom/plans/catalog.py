"""Registered queries: each reads whole tables of a data folder and returns flat rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import rules as R
from matchloom import schemas as S
from matchloom.functions import text as X
from matchloom.functions.rows import explode_rows, inline_rows, settle
from matchloom.operators import coverage as C
from matchloom.operators import delta, embedding, evaluation, matching, parsing, prompts, redaction, rendering
from matchloom.operators import retrieval, skills, style, validation
from matchloom.plans.corpus import (
    jd_corpus,
    jobs,
    parsed_jds,
    parsed_resumes,
    resume_corpus,
    spread,
    table,
)
from matchloom.session import materialise, shared_dir
from matchloom.sources import intake, snapshots, tables, vector_index
from matchloom.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEYS = ["tenantId", "jobId"]
NOW = 1706659200  # 2024-01-31, just after the last event: a fixed clock for repeatable results


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(c: str, sep: str = "|"):
    return F.array_join(c, sep)


def _instant(ts: str):
    """The event times carry no zone and are meant as UTC, whatever the zone of the session."""
    return F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone())


def _epoch(ts: str):
    return F.unix_timestamp(_instant(ts))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


# --- lines, sections, parsing ---------------------------------------------

@query
def line_explode(spark, sf):
    return parsing.explode_lines(_documents(spark, sf).select("doc_id", "text"))


@query
def resume_roles(spark, sf):
    roles = parsing.resume_roles(parsed_resumes(spark, sf).select(*KEYS, "resume"))
    return roles.withColumn("achievements", F.size("achievements"))


@query
def resume_bullets(spark, sf):
    return parsing.resume_bullets(parsed_resumes(spark, sf).select(*KEYS, "resume"))


@query
def resume_sections(spark, sf):
    """Lines per section. Counted inside each document's row, so nothing is shuffled."""
    return parsing.section_sizes(resume_corpus(spark, sf).select(*KEYS, "text"))


@query
def resume_summary(spark, sf):
    r = parsed_resumes(spark, sf)
    return r.select(
        *KEYS,
        "resume.summary",
        "resume.meta.role",
        "resume.meta.updatedAt",
        _joined("resume.education").alias("education"),
        _joined("resume.skills").alias("skills"),
    )


@query
def projects_fold(spark, sf):
    return inline_rows(parsed_resumes(spark, sf), KEYS, "resume.projects")


@query
def jd_sections(spark, sf):
    return parsing.label_jd_sections(jd_corpus(spark, sf).select("pk", "text"))


@query
def jd_canonical(spark, sf):
    return parsed_jds(spark, sf).select(
        "pk",
        "job.meta.*",
        "job.summary",
        _joined("job.responsibilities").alias("responsibilities"),
        _joined("job.requirements").alias("requirements"),
        _joined("job.skills").alias("skills"),
    )


@query
def derive_skills(spark, sf):
    d = skills.derive_skills(_documents(spark, sf).select("doc_id", "text"))
    return explode_rows(d, ["doc_id"], "skills", "skill")


# --- style ----------------------------------------------------------------

@query
def style_signals(spark, sf):
    return style.style_signals(_documents(spark, sf).select("doc_id", "text")).select(
        "doc_id", "heading_case", "layout_density"
    )


@query
def style_profile(spark, sf):
    k = F.col("k")
    metadata = F.struct(
        F.when(k % 4 == 0, F.array(F.lit("skills"), F.lit("summary"))).alias("sectionOrder"),
        F.lit(None).cast("string").alias("headingCase"),
        F.lit(None).cast("string").alias("bulletStyle"),
        F.when(k % 5 == 0, "Arial").alias("fontFamily"),
        F.when(k % 3 == 0, F.lit(11.0)).when(k % 3 == 1, F.lit(26.0)).alias("fontSize"),
        F.lit(None).cast("string").alias("layoutDensity"),
        F.lit(None).cast("boolean").alias("includeSectionDividers"),
        F.lit(None).cast("string").alias("accentColor"),
    )
    texts = resume_corpus(spark, sf).select(*KEYS, "text", metadata.alias("style_metadata"))
    return style.build_style_profiles(texts).select(
        *KEYS,
        _joined("profile.sectionOrder", ",").alias("section_order"),
        F.col("profile.bulletStyle").alias("bullet_style"),
        F.col("profile.fontFamily").alias("font_family"),
        F.col("profile.fontSize").alias("font_size"),
        F.col("profile.layoutDensity").alias("layout_density"),
    )


# --- personal data --------------------------------------------------------

@query
def pii_flags(spark, sf):
    return redaction.pii_flags(_documents(spark, sf).select("doc_id", "text")).drop("text")


@query
def pii_redact(spark, sf):
    return _documents(spark, sf).select("doc_id", X.redact_patterns("text").alias("text"))


@query
def span_redact(spark, sf):
    docs = _documents(spark, sf).select("doc_id", "text")
    n = F.length("text")
    spans = F.array(
        F.struct((n - 5).alias("begin"), n.alias("end")),
        F.struct(F.lit(0).alias("begin"), F.lit(5).alias("end")),
    )
    entities = inline_rows(docs.where(n >= 10), ["doc_id"], spans)
    return redaction.redact_with_entities(docs, entities, ["doc_id"])


# --- scalars --------------------------------------------------------------

@query
def tokens(spark, sf):
    return explode_rows(_documents(spark, sf), ["doc_id"], X.tokens("text"), "token")


@query
def token_norm(spark, sf):
    texts = table(spark, sf, "conversations").select("text").unionByName(table(spark, sf, "benchmark").select("text"))
    return explode_rows(texts, [], X.tokens("text"), "token").groupBy("token").agg(F.count(F.lit(1)).alias("texts"))


@query
def readability(spark, sf):
    return evaluation.readability(_documents(spark, sf).select("doc_id", "text")).drop("text", "grade")


@query
def escape_xml(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.escape_xml("html").alias("html"))


@query
def title_case(spark, sf):
    name = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" o'neil"))
    return table(spark, sf, "part").select("p_partkey", X.title_case(name).alias("titled"))


# --- skills and chunks ----------------------------------------------------

@query
def skill_aggregate(spark, sf):
    lists = skills.skill_lists(jobs(spark, sf))
    ranked = skills.rank_skills(skills.aggregate_skills(lists))
    return ranked.withColumn("sources", _joined("sources", ","))


@query
def corpus_skills(spark, sf):
    """Capitalised words per language over all documents, repeats counted."""
    words = F.regexp_extract_all(
        "text", F.lit(r"(?<![A-Za-z+#])(?:[A-Z][A-Za-z+#]+|[+#]+[A-Z][A-Z+#]*(?![A-Za-z+#]))"), F.lit(0)
    )
    lists = _documents(spark, sf).select("lang", "source", words.alias("skills"))
    return skills.aggregate_skills(lists, ["lang"]).withColumn("sources", _joined("sources", ","))


def _document_chunks(spark, sf):
    return table(spark, sf, "documents").select(
        "source", "text", (F.col("n_chars") % 97).cast("double").alias("score"), F.col("doc_id").alias("arrival"), "doc_id"
    )


@query
def chunk_dedup(spark, sf):
    best = retrieval.dedup_best(_document_chunks(spark, sf), ["source"], payload=("doc_id",))
    return best.withColumnRenamed("doc_id", "best_doc")


@query
def topk_chunks(spark, sf):
    best = retrieval.dedup_best(_document_chunks(spark, sf), ["source"])
    return retrieval.top_chunks(best, ["source"]).select("source", "first_seen", "score", "chunk_no")


# --- nearest neighbours and retrieval -------------------------------------

@query
def knn_cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    queries = e.select("label", F.col("vec_id").alias("query_id"), "embedding")
    vectors = e.select("label", F.col("vec_id").alias("doc_id"), "embedding")
    return matching.nearest(queries, vectors, keys=["label"]).withColumn("score", F.round("score", 6))


@query
def knn_cross_tenant(spark, sf):
    e = table(spark, sf, "embeddings")
    queries = e.select(F.col("vec_id").alias("query_id"), "embedding")
    vectors = e.select(F.col("vec_id").alias("doc_id"), "embedding")
    return matching.nearest(queries, vectors, keys=()).withColumn("score", F.round("score", 6))


def _stored_vectors(spark, sf, path):
    """The vectors in an index: three quarters when it is made, the others and new versions of some by upserts."""
    e = table(spark, sf, "embeddings").select(
        F.concat(F.lit("t"), "label").alias("tenantId"), F.col("vec_id").alias("id"), "embedding"
    )
    turned = e.where("id % 5 = 0").withColumn("embedding", F.reverse("embedding"))  # mostly another bucket
    vector_index.create(e.where("id % 4 <> 3").where("id % 5 <> 0").unionByName(turned), path)
    vector_index.upsert(e.where("id % 4 = 3"), path, version=2)
    vector_index.compact(spark, path)
    vector_index.upsert(e.where("id % 5 = 0"), path, version=3)
    return e.withColumnRenamed("id", "query_id")


@query
def knn_index(spark, sf):
    """All buckets of the stored index: the exact answer, whatever moved from bucket to bucket."""
    path = shared_dir(spark, "vector-index")
    queries = _stored_vectors(spark, sf, path)
    found = vector_index.search(spark, path, queries, probes=vector_index.MAX_BUCKETS)
    return found.withColumn("score", F.round("score", 6))


@query
def knn_index_recall(spark, sf):
    """The usual search of the stored index against the exact neighbours, per tenant."""
    path = shared_dir(spark, "vector-index")
    queries = _stored_vectors(spark, sf, path)
    found = vector_index.search(spark, path, queries).select("tenantId", "query_id", "doc_id", F.lit(1).alias("hit"))
    vectors = queries.withColumnRenamed("query_id", "doc_id")
    exact = matching.nearest(queries, vectors).select("tenantId", "query_id", "doc_id")
    met = exact.join(found, ["tenantId", "query_id", "doc_id"], "left")
    counted = met.groupBy("tenantId").agg(F.count(F.lit(1)).alias("neighbours"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
    return counted.select("tenantId", "neighbours", (F.col("hits") >= 0.9 * F.col("neighbours")).alias("recalled"))


def _feedback(spark, sf):
    e = table(spark, sf, "events")
    job = F.concat(F.lit("j"), "user_id")
    return e.select(
        F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenantId"),
        F.concat(job, F.lit("#"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("feedbackId"),
        F.concat("event_type", F.lit(" "), (F.col("event_id") % 4)).alias("text"),
        (F.col("value") / 100.0).alias("score"),
        F.array("event_type").alias("tags"),
    )


def _retrieved(spark, sf):
    e = table(spark, sf, "embeddings")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    vectors = e.join(docs, "vec_id", "left").select(
        F.concat(F.lit("t"), F.col("vec_id") % 3).alias("tenantId"),
        F.concat(F.lit("d"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.create_map(F.lit("source"), F.col("source")).alias("metadata"),
        "embedding",
    )
    n = F.floor(F.col("vec_id") / 3)
    queries = e.select(
        F.concat(F.lit("t"), n % 3).alias("tenantId"),
        F.concat(F.lit("j"), n).alias("jobId"),
        (F.col("vec_id") % 3).cast("int").alias("query_no"),
        "embedding",
    )
    return retrieval.retrieve_context(queries, vectors, _feedback(spark, sf))


@query
def retrieve_context(spark, sf):
    return _retrieved(spark, sf).select(*KEYS, "chunk_no", "id", "text")


@query
def context_details(spark, sf):
    """Score, metadata and tags of the retrieved chunks."""
    source = F.coalesce(F.element_at("metadata", "source"), F.lit(""))
    tags = F.coalesce(F.array_join("tags", ","), F.lit(""))
    return _retrieved(spark, sf).select(*KEYS, "chunk_no", "id", F.round(F.col("score") * 10000).cast("int").alias("score_e4"), source.alias("source"), tags.alias("tags"))


@query
def context_coverage(spark, sf):
    """Each job with its chunks, and how much of its description they hold."""
    chunks = _retrieved(spark, sf)
    k = F.col("vec_id")
    wanted = table(spark, sf, "embeddings").where("vec_id % 3 = 0").select(
        F.concat(F.lit("t"), F.floor(k / 3) % 3).alias("tenantId"), F.concat(F.lit("j"), F.floor(k / 3)).alias("jobId"),
        F.from_json(F.lit('{"requirements": ["error", "purchase"], "responsibilities": ["view 1", "nowhere"], "skills": ["click"]}'), S.JOB_DESCRIPTION).alias("job"),
    )
    scored = retrieval.with_coverage(wanted, chunks)
    return scored.select(*KEYS, F.size("chunks").alias("chunks"), "coverage.requirements", "coverage.responsibilities", "coverage.skills")


@query
def feedback_prefix(spark, sf):
    rows = retrieval.scan_feedback(_feedback(spark, sf))
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("items"), F.max("score").alias("best"))


# --- coverage -------------------------------------------------------------

def _bodies(spark, sf, *cols):
    return _documents(spark, sf).select(F.col("doc_id").alias("text_id"), "text", *cols)


@query
def substring_coverage(spark, sf):
    return C.substring_coverage(table(spark, sf, "benchmark"), _bodies(spark, sf), [])


@query
def substring_coverage_index(spark, sf):
    """As without a bound on the needles: by the inverted index."""
    return C.substring_coverage(table(spark, sf, "benchmark"), _bodies(spark, sf), [], force_index=True)


def _substring_items(spark, sf, force_index=False):
    docs = _bodies(spark, sf, "source")
    needles = table(spark, sf, "benchmark").select(F.col("item_id").alias("needle_id"), F.lower("text").alias("needle"))
    pairs = matching.contained(docs.withColumn("text", F.lower("text")), needles, pairs=True, force_index=force_index)
    return (
        pairs.join(docs.select("text_id", "source"), "text_id")
        .groupBy("source", F.col("needle_id").alias("item_id"))
        .agg(F.count(F.lit(1)).alias("texts"))
    )


@query
def substring_items(spark, sf):
    return _substring_items(spark, sf)


@query
def substring_items_index(spark, sf):
    return _substring_items(spark, sf, force_index=True)


@query
def chunk_coverage(spark, sf):
    chunks = F.array(F.array_join("resume.skills", " "), F.col("resume.summary"))
    scored = C.add_chunk_coverage(jobs(spark, sf), chunks)
    return scored.select(*KEYS, "coverage.requirements", "coverage.responsibilities", "coverage.skills", "coverage.mean")


def _turns(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return t.where(F.col("role") != "assistant"), t.where(F.col("role") == "assistant")


@query
def token_coverage(spark, sf):
    asked, answered = _turns(spark, sf)
    return C.token_coverage(asked, answered, ["conv_id"], target_id="turn")


@query
def missing_targets(spark, sf):
    asked, answered = _turns(spark, sf)
    covered = C.token_coverage(asked, answered, ["conv_id"], target_id="turn").where(~F.col("covered"))
    texts = asked.select("conv_id", F.col("turn").alias("target_id"), "text")
    return texts.join(covered.select("conv_id", "target_id"), ["conv_id", "target_id"])


@query
def keyword_coverage(spark, sf):
    asked, answered = _turns(spark, sf)
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(rf"[^{R.SPACE}]+"), F.lit(0)))
    keywords = explode_rows(asked, ["conv_id"], words, "keyword").distinct().withColumn("text", F.col("keyword"))
    return C.coverage_scores(C.token_coverage(keywords, answered, ["conv_id"], target_id="keyword"), ["conv_id"])


def _unsupported(spark, sf, force_index=False):
    bullets = table(spark, sf, "benchmark").select(F.col("item_id").alias("bullet_id"), "text")
    return C.unsupported(bullets, _bodies(spark, sf), force_index=force_index).withColumnRenamed("bullet_id", "item_id")


@query
def unsupported(spark, sf):
    return _unsupported(spark, sf)


@query
def unsupported_index(spark, sf):
    return _unsupported(spark, sf, force_index=True)


def _banned_claims(spark, sf, force_index=False):
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("keyword")).distinct()
    docs = _documents(spark, sf).select("doc_id", F.col("text").alias("payload"))
    return validation.banned_claims(docs, words, ["doc_id"], force_index=force_index)


@query
def banned_claims(spark, sf):
    return _banned_claims(spark, sf)


@query
def banned_claims_index(spark, sf):
    return _banned_claims(spark, sf, force_index=True)


# --- scores ---------------------------------------------------------------

@query
def bullet_consistency(spark, sf):
    r = settle(parsed_resumes(spark, sf).select(*KEYS, "resume"), _b=parsing.all_bullets("resume"))
    scored = evaluation.add_consistency(r, F.col("_b"))
    return scored.select(*KEYS, F.size("_b").cast("long").alias("bullets"), "consistency")


@query
def turn_consistency(spark, sf):
    return evaluation.bullet_consistency(table(spark, sf, "conversations"), ["conv_id"]).drop("consistency")


def _evaluated(spark, sf):
    notes = F.array(F.struct(F.lit("Notes: HANDLED RETURNS daily").alias("text")))
    chunks = F.when(F.col("k") % 2 == 0, notes).otherwise(F.array().cast("array<struct<text:string>>"))
    rows = jobs(spark, sf, evaluation.prepare_jobs).withColumn("chunks", chunks)
    return evaluation.evaluate(rows, wanted="wanted")


@query
def evaluate_report(spark, sf):
    return _evaluated(spark, sf).select(
        *KEYS,
        "targets",
        "targetHits",
        "keywords",
        "keywordHits",
        _joined("missingCoverageTargets").alias("missing"),
        _joined("missingAtsKeywords").alias("missing_keywords"),
        F.size("hallucinations").alias("unsupported"),
        F.col("readabilityGradeLevel").alias("grade"),
    )


@query
def quality_gate(spark, sf):
    return evaluation.quality_gate(_evaluated(spark, sf)).select(*KEYS, "passed")


# --- validation -----------------------------------------------------------

def _generated(spark, sf):
    """Parsed resumes with a change log and a cover letter, as generation would leave them."""
    k = F.col("k")
    entry = F.struct(
        F.when(k % 19 != 0, F.lit("bullet")).alias("type"),
        F.lit("Updated").alias("detail"),
        F.when(k % 23 != 0, F.lit("")).alias("rationale"),
    )
    letter = F.struct(
        F.lit("Hello").alias("intro"),
        F.when(k % 29 == 0, F.repeat(F.lit("word "), F.lit(801))).otherwise(F.lit("Short")).alias("body"),
        F.when(k % 31 == 0, F.lit("rude")).otherwise(F.lit("formal")).alias("tone"),
    )
    return (
        parsed_resumes(spark, sf)
        .withColumn("changeLog", F.array(entry))
        .withColumn("coverLetter", F.when((k % 2 == 1) | (k % 29 == 0), letter).cast(S.COVER_LETTER))
    )


def _validated(spark, sf):
    return validation.validate_resumes(_generated(spark, sf), banned=["Freelance", "wizard"])


@query
def validate_issues(spark, sf):
    return validation.explode_issues(_validated(spark, sf), KEYS)


@query
def validate_status(spark, sf):
    return _validated(spark, sf).select(
        *KEYS,
        "status",
        F.col("metrics.bulletCount").alias("bullet_count"),
        F.col("metrics.skillsCount").alias("skills_count"),
    )


@query
def gate(spark, sf):
    # both ways out read the outcome of one validation
    passed, failed = validation.gate(materialise(_validated(spark, sf).select("tenantId", "status"), "outcomes"))
    both = passed.withColumn("step", F.lit("render")).unionByName(failed.withColumn("step", F.lit("fail")))
    return both.groupBy("tenantId", "step").agg(F.count(F.lit(1)).alias("jobs"))


# --- embedding documents, queries, prompts --------------------------------

def _embedding_docs(spark, sf):
    # a resume is read as the base of its own job and as the validated one of the next; only the fields that become
    # documents are written and moved, neither the raw texts nor the other sections
    def fields(c, *names):
        return F.struct(*[F.col(f"{c}.{n}").alias(n) for n in names]).alias(c)

    resume = fields("resume", "meta", "summary", "experience", "skills")
    resumes = materialise(parsed_resumes(spark, sf).select(*KEYS, "k", "jd_key", resume), "resumes")
    job = fields("job", "meta", "summary", "requirements", "responsibilities", "skills")
    descriptions = parsed_jds(spark, sf).select(F.col("pk").alias("jd_key"), job)
    before = resumes.select((F.col("k") + 1).alias("k"), F.array("resume").alias("validated"))
    rows = resumes.join(descriptions, "jd_key").join(before, "k", "left")
    none = F.array().cast(before.schema["validated"].dataType)
    return embedding.job_documents(rows.withColumn("validated", F.coalesce("validated", none)))


@query
def embedding_docs(spark, sf):
    label = F.coalesce(*[F.element_at("metadata", k) for k in ("title", "company", "sourceKey", "sources")])
    return _embedding_docs(spark, sf).select(
        "id", "text", F.element_at("metadata", "type").alias("type"), label.alias("label")
    )


@query
def query_texts(spark, sf):
    return embedding.build_queries(jobs(spark, sf))


@query
def embedding_summary(spark, sf):
    summary = embedding.embedding_summary(_embedding_docs(spark, sf), "index", "collection")
    return summary.select(
        *KEYS,
        _joined("vectorIds").alias("vector_ids"),
        F.col("documentCount").alias("document_count"),
        F.col("index").alias("index_name"),
        "collection",
        F.col("timestamp").isNotNull().alias("stamped"),
    )


PLAN_TEMPLATE = "Rewrite the plan {alignmentPlan} with options {options}. Answer with JSON {{bullets}}."


@query
def prompt_rows(spark, sf):
    k = F.col("k")
    rows = resume_corpus(spark, sf).select(
        *KEYS,
        F.concat(F.lit('{"alignments": ['), "k", F.lit("]}")).alias("out_experience_alignment"),
        F.lit(None).cast(S.STYLE_PROFILE).alias("profile"),
        F.struct(
            F.when(k % 2 == 0, "formal").alias("tone"),
            F.when(k % 3 == 0, F.array(F.substring_index(F.element_at("metadata", "role"), " buyer", 1))).alias("keywords"),
            F.lit(None).cast("string").alias("length"),
            F.lit(None).cast("boolean").alias("includeCoverLetter"),
        ).alias("options"),
        *[F.lit(None).cast("string").alias(f"out_{s}") for s in R.PROMPT_STAGES if s != "experience_alignment"],
    )
    templates = spark.createDataFrame(
        [("bullet_rewrite", PLAN_TEMPLATE, ["</response>"])], "name string, template string, stopSequences array<string>"
    )
    return prompts.build_prompts(prompts.stage_rows(rows, "bullet_rewrite"), templates).select(*KEYS, "prompt")


@query
def model_output(spark, sf):
    """Responses in all four shapes, written around the JSON of each event."""
    quoted = F.to_json(F.array("props"))
    text = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    shape = F.col("event_id") % 4
    payload = (
        F.when(shape == 0, F.concat(F.lit('{"results": [{"outputText": '), text, F.lit("}]}")))
        .when(shape == 1, F.concat(F.lit('{"results": [], "output": [{"outputText": "", "text": '), text, F.lit("}]}")))
        .when(shape == 2, F.concat(F.lit('{"outputText": '), text, F.lit("}")))
        .otherwise(F.col("props"))
    )
    return table(spark, sf, "events").select("event_id", prompts.extract_output(payload).alias("text"))


@query
def model_json(spark, sf):
    raw = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("no json: "), "props")).otherwise(F.col("props"))
    good, bad = prompts.parse_model_json(table(spark, sf, "events").select("event_id", raw.alias("raw")), "struct<k:int>")
    ok = good.select("event_id", F.col("data.k").alias("k"), F.lit("ok").alias("outcome"))
    return ok.unionByName(bad.select("event_id", F.lit(-1).alias("k"), F.lit("reject").alias("outcome")))


# --- rendering ------------------------------------------------------------

def _styled(spark, sf):
    k = F.col("k")
    profile = F.struct(
        F.when(k % 2 == 0, F.array(F.lit("skills"), F.lit("other"), F.lit("summary"))).alias("sectionOrder"),
        F.when(k % 3 == 0, "upper").when(k % 3 == 1, "title").otherwise("sentence").alias("headingCase"),
        F.when(k % 4 == 0, "dash").when(k % 4 == 1, "asterisk").otherwise("bullet").alias("bulletStyle"),
        F.lit("Arial").alias("fontFamily"),
        F.when(k % 5 == 0, F.lit(8)).otherwise(F.lit(22)).alias("fontSize"),
        F.when(k % 7 == 0, "condensed").when(k % 7 == 1, "spacious").otherwise("balanced").alias("layoutDensity"),
        (k % 10 == 0).alias("includeSectionDividers"),
        F.lit(None).cast("string").alias("accentColor"),
    ).cast(S.STYLE_PROFILE)
    entry = F.struct(
        F.lit("bullet").alias("type"),
        F.concat(F.lit("<b>"), k, F.lit("</b>")).alias("detail"),
        F.lit("x").alias("rationale"),
    )
    log = F.when(k % 6 == 0, F.array(entry)).otherwise(F.array().cast(S.CHANGE_LOG))
    return parsed_resumes(spark, sf).withColumn("profile", profile).withColumn("changeLog", log)


@query
def render_lines(spark, sf):
    return rendering.render_text_lines(_styled(spark, sf), KEYS)


@query
def render_paragraphs(spark, sf):
    return rendering.render_paragraphs(_styled(spark, sf), KEYS).drop("font")


@query
def section_order(spark, sf):
    k = F.col("o_orderkey")
    preferred = F.when(k % 2 == 0, F.array(*[F.lit(s) for s in ("education", "hobbies", "skills")]))
    return table(spark, sf, "orders").select(
        "o_orderkey", _joined(rendering.order_sections(preferred), ",").alias("section_order")
    )


# --- intake ---------------------------------------------------------------

def _uploads(spark, sf):
    good = F.base64(F.encode("text", "UTF-8"))
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.concat(F.lit("t"), F.col("conv_id") % 5).alias("tenantId"),
        F.col("role").alias("kind"),
        F.when(F.col("text") == "", "")
        .when(F.col("turn") % 4 == 3, F.concat(F.lit("*"), good))
        .otherwise(F.translate(good, "\r\n", ""))
        .alias("content_b64"),
        F.when(
            F.col("turn") % 2 == 0,
            F.create_map(F.lit("turn"), F.col("turn").cast("string"), F.lit("kind"), F.lit("override")),
        )
        .otherwise(F.create_map(F.lit("turn"), F.col("turn").cast("string")))
        .alias("metadata"),
    )


@query
def ingest(spark, sf):
    documents, _ = intake.ingest_uploads(_uploads(spark, sf))
    return documents.select("tenantId", "kind", "key", F.decode("content", "UTF-8").alias("text"))


@query
def rejects(spark, sf):
    _, bad = intake.ingest_uploads(_uploads(spark, sf))
    return bad.select("conv_id", "turn", "reason")


@query
def upload_metadata(spark, sf):
    documents, _ = intake.ingest_uploads(_uploads(spark, sf))
    return intake.upload_metadata(documents).drop("createdAt")


def _requests(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("t"), F.col("o_custkey") % 7).alias("tenantId"),
        F.concat(F.lit("j"), k).alias("jobId"),
        F.concat(F.lit("jd/"), "o_custkey").alias("jobDescriptionKey"),
        F.when(k % 9 != 0, F.concat(F.lit("cv/"), k)).alias("baseResumeKey"),
        F.when(k % 3 == 0, F.concat(F.lit("style/"), k % 10)).alias("styleGuideKey"),
    )


@query
def requests(spark, sf):
    good, _ = intake.normalise_requests(_requests(spark, sf))
    return good.select(
        *KEYS,
        F.col("jobDescription.s3Key").alias("jd_key"),
        F.col("baseResume.s3Key").alias("resume_key"),
        F.col("styleGuide.s3Key").alias("style_key"),
    )


@query
def execution_inputs(spark, sf):
    """Requests whose ``executionInput`` wins over the single columns, options included."""
    k = F.col("c_custkey")
    none = lambda name, ddl: F.lit(None).cast(ddl).alias(name)
    pointer = lambda text: F.struct(none("s3Key", "string"), text.alias("text"), none("metadata", S.METADATA), none("documentType", "string"))
    tone = lambda c: F.struct(c.alias("tone"))
    given = F.struct(
        F.concat(F.lit("job-"), k).alias("jobId"), pointer(F.col("c_name")).alias("jobDescription"),
        pointer(F.when(k % 4 != 1, F.col("c_mktsegment"))).alias("baseResume"), tone(F.lit("formal")).alias("options"),
    )
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("t"), k % 3).alias("tenantId"), F.concat(F.lit("plain-"), k).alias("jobId"), F.lit("jd").alias("jobDescriptionKey"),
        F.lit("cv").alias("baseResumeKey"), tone(F.col("c_mktsegment")).alias("options"), F.when(k % 2 == 1, given).alias("executionInput"),
    )
    good, bad = intake.normalise_requests(rows)
    return good.select("tenantId", "jobId", "options.tone", F.lit("").alias("reason")).unionByName(
        bad.select("tenantId", "jobId", "options.tone", "reason")
    )


@query
def request_rejects(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 8 != 0, F.lit("t")).alias("tenantId"),
        k.cast("string").alias("jobId"),
        F.lit("jd").alias("jobDescription"),
        F.when(k % 9 != 0, F.lit("cv")).alias("baseResume"),
    )
    _, bad = intake.validate_requests(rows)

    def named(field):
        return F.when(F.array_contains("missing", field), field).otherwise("")

    return bad.select("o_orderkey", named("tenantId").alias("missing_tenant"), named("baseResume").alias("missing_resume"))


@query
def resolve_documents(spark, sf):
    k = F.col("o_orderkey")
    pointers = table(spark, sf, "orders").select(
        "o_orderkey",
        F.struct(
            F.col("o_custkey").cast("string").alias("s3Key"),
            F.when(k % 4 == 0, F.concat(F.lit("inline "), k)).otherwise("").alias("text"),
        ).alias("pointer"),
    )
    objects = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("key"), F.encode("text", "UTF-8").alias("content")
    )
    found, _ = intake.resolve_documents(pointers, objects)
    return found.select("o_orderkey", "text")


@query
def assemble_blocks(spark, sf):
    block_type = F.when(F.col("role") == "system", "PAGE").when(F.col("role") == "user", "LINE").otherwise("CELL")
    blocks = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seq"), block_type.alias("blockType"), "text")
    return intake.assemble_blocks(blocks, ["conv_id"])


# --- job state, artifacts, streams ----------------------------------------

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _status_rows(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenantId"),
        F.concat(F.lit("j"), "user_id").alias("jobId"),
        F.when(kind == "purchase", "RESULT").otherwise("STATUS").alias("entityType"),
        F.when(kind == "purchase", "COMPLETED").when(kind == "error", "FAILED").otherwise("RUNNING").alias("status"),
        "event_id",
        _epoch("ts").alias("updatedAt"),
    )


@query
def latest_status(spark, sf):
    return tables.latest(_status_rows(table(spark, sf, "events")), tables.STATUS_KEYS, ("updatedAt", "event_id"))


@query
def job_status(spark, sf):
    status = _status_rows(table(spark, sf, "events"))
    asked = table(spark, sf, "customer").select(
        F.concat(F.lit("t"), F.col("c_custkey") % 3).alias("tenantId"), F.concat(F.lit("j"), "c_custkey").alias("jobId")
    )
    best = tables.current_job_status(asked, status)
    raw = tables.current_job_status(asked, status, raw=True).withColumnRenamed("status", "raw_status")
    return best.join(raw, KEYS)


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return (
        spark.readStream.schema(EVENTS_SCHEMA)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{sf}/[e]vents.parquet")  # as a pattern, both a file and a folder are read
    )


@query
def stream_upsert(spark, sf):
    path, checkpoint = shared_dir(spark, "status"), shared_dir(spark, "status-checkpoint")
    rows = _status_rows(_event_stream(spark, sf))
    order = ("updatedAt", "event_id")
    streams.stream_upsert(rows, path, checkpoint, tables.STATUS_KEYS, order, ["tenantId"]).awaitTermination()
    return snapshots.read(spark, path, tables.STATUS_KEYS, order)


@query
def keyed_table(spark, sf):
    """Three writes with a compaction between them, and what a reader then finds."""
    path, order = shared_dir(spark, "status-table"), ("updatedAt", "event_id")
    rows = _status_rows(table(spark, sf, "events"))
    snapshots.append(rows.where("event_id % 3 = 0"), path, "first", ["tenantId"])
    snapshots.append(rows.where("event_id % 3 = 1"), path, "second", ["tenantId"])
    snapshots.compact(spark, path, tables.STATUS_KEYS, order, ["tenantId"])
    snapshots.append(rows.where("event_id % 3 = 2"), path, "third", ["tenantId"])
    snapshots.append(rows.where("event_id % 3 = 2"), path, "third", ["tenantId"])  # a repeated write adds nothing
    return snapshots.read(spark, path, tables.STATUS_KEYS, order)


def _job_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenantId"),
        F.concat(F.lit("j"), F.floor(F.col("event_id") / 3)).alias("jobId"),
        F.when(kind == "purchase", "RESULT").otherwise("STATUS").alias("entityType"),
        F.when(kind == "error", "FAILED").otherwise("RUNNING").alias("status"),
        _epoch("ts").alias("updatedAt"),
        _instant("ts").alias("ts"),
    )


@query
def stuck_jobs(spark, sf):
    events = _job_events(table(spark, sf, "events"))
    return tables.stuck_jobs(events, events.agg(F.max("updatedAt")).scalar())


@query
def stuck_jobs_stream(spark, sf):
    """The rule of ``stuck_jobs`` by timers in event time, over the same events as a stream."""
    path, checkpoint = shared_dir(spark, "stuck"), shared_dir(spark, "stuck-checkpoint")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, streams.ROCKSDB)
    try:
        found = streams.stream_stuck(_job_events(_event_stream(spark, sf)), lateness="0 seconds")
        writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    rows = spark.read.schema(found.schema).parquet(path)
    return rows.select(*KEYS, F.unix_millis("startedAt").alias("started_ms"))


@query
def retention(spark, sf):
    """What is left of the objects after two runs of the clean-up."""
    path = shared_dir(spark, "objects")
    objects = _objects(table(spark, sf, "events")).select(F.concat(F.lit("t"), "tenant").alias("tenantId"), "event_id", "lastModified")
    tables.write_objects(objects, path)
    for _ in range(2):
        tables.prune_objects(spark, path, NOW)
    left = spark.read.schema("event_id long, lastModified long, tenantId string, day date").parquet(path)
    return left.select("tenantId", "event_id", "lastModified")


def _objects(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        (F.col("user_id") % 3).alias("tenant"),
        _epoch("ts").alias("lastModified"),
    )


@query
def expired_artifacts(spark, sf):
    old = tables.expired_artifacts(_objects(table(spark, sf, "events")), F.lit(NOW))
    return old.groupBy("tenant").agg(F.count(F.lit(1)).alias("expired"))


@query
def stream_retention(spark, sf):
    path, checkpoint = shared_dir(spark, "prune"), shared_dir(spark, "prune-checkpoint")
    rows = _objects(_event_stream(spark, sf))
    streams.stream_retention(rows, F.lit(NOW), path, checkpoint).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path).select("event_id")


def _manifest(spark, sf):
    k = F.col("o_orderkey")
    finished = table(spark, sf, "orders").select(
        F.concat(F.lit("t"), F.col("o_custkey") % 7).alias("tenantId"),
        F.concat(F.lit("j"), k).alias("jobId"),
        F.when(k % 2 == 0, F.lit("letter")).alias("coverLetter"),
        F.when(k % 3 == 0, F.lit("profile")).alias("profile"),
    )
    return tables.manifest_keys(tables.artifact_manifest(finished, F.lit(NOW)))


@query
def artifact_manifest(spark, sf):
    return _manifest(spark, sf)


@query
def list_artifacts(spark, sf):
    return tables.list_artifacts(_manifest(spark, sf), "t1")


@query
def stream_fail_alarm(spark, sf):
    path, checkpoint = shared_dir(spark, "alarms"), shared_dir(spark, "alarms-checkpoint")
    events = _event_stream(spark, sf).select(_instant("ts").alias("ts"), "event_type")
    streams.stream_alarms(events, F.col("event_type") == "error", path, checkpoint).awaitTermination()
    alarms = streams.current_alarms(spark.read.schema("window_start timestamp, failures long, batch_id long").parquet(path))
    return alarms.withColumn("window_start", F.unix_timestamp("window_start"))


@query
def alarm_once(spark, sf):
    """One alarm per window with a failure, over a stream that is stopped and started again."""
    path, checkpoint = shared_dir(spark, "alarm"), shared_dir(spark, "alarm-checkpoint")
    events = _event_stream(spark, sf).select(_instant("ts").alias("ts"), "event_type")
    for _ in range(2):
        streams.stream_alarm_once(events, F.col("event_type") == "error", path, checkpoint).awaitTermination()
    return spark.read.schema("window_start timestamp").parquet(path).select(F.unix_timestamp("window_start").alias("window_start"))


# --- conformance and differences ------------------------------------------

@query
def schema_check(spark, sf):
    checked = delta.schema_conformance(parsed_resumes(spark, sf), "resume", "resume")
    return checked.select(*KEYS, F.size("problems").alias("problems"), "conforms")


def _tailored(k, resume):
    """A new version of a resume: other skills, summary and education, roles moved, removed and renamed."""
    own = resume["skills"]
    first_up = F.transform(own, lambda s, i: F.when(i == 0, F.upper(s)).otherwise(s))
    changed = F.when(k % 2 == 0, first_up).otherwise(own)
    added = F.when(k % 3 == 0, F.concat(changed, F.array(F.lit("Added")))).otherwise(changed)
    roles = resume["experience"]
    renamed = F.transform(roles, lambda r, i: F.when(i == 2, r.withField("title", F.concat(r["title"], F.lit(" II")))).otherwise(r))
    experience = (
        F.when(k % 8 == 6, F.reverse(roles)).when(k % 8 == 3, F.filter(roles, lambda _, i: i != 1)).when(k % 8 == 7, renamed).otherwise(roles)
    )
    projects = F.transform(resume["projects"], lambda p: F.when(k % 9 == 0, p.withField("description", F.lit("short"))).otherwise(p))
    return (
        resume.withField("skills", added)
        .withField("summary", F.when(k % 5 == 0, F.lit("short")).otherwise(resume["summary"]))
        .withField("education", F.when(k % 4 == 0, F.slice(resume["education"], 1, 1)).otherwise(resume["education"]))
        .withField("experience", experience)
        .withField("projects", projects)
    )


@query
def resume_diff(spark, sf):
    rows = parsed_resumes(spark, sf).withColumn("tailored", _tailored(F.col("k"), F.col("resume")))
    changes = delta.resume_changes(rows, "resume", "tailored", KEYS)
    return changes.select(*KEYS, "section", "slot", "action", F.coalesce("detail", F.lit("")).alias("detail"))


# --- redaction, style packages, vectors, model answers --------------------

@query
def redact_fields(spark, sf):
    redacted = redaction.redact_jobs(jobs(spark, sf), enabled=F.col("k") % 2 == 0)
    return redacted.select(*KEYS, F.col("resume.summary").alias("resume_summary"), F.col("job.summary").alias("job_summary"))


@query
def package_style(spark, sf):
    k = F.col("k")
    profile = F.when(k % 2 == 0, F.struct(F.lit("dash").alias("bulletStyle")))
    sample = F.struct(
        F.struct(F.element_at("metadata", "role").alias("role")).alias("meta"),
        F.when(k % 6 != 0, F.concat(F.lit("guide "), k)).alias("rawText"),
    )
    pointer = F.struct(
        F.concat(F.lit("style/"), k).alias("s3Key"), F.col("metadata"), F.lit("styleGuide").alias("documentType")
    )
    rows = resume_corpus(spark, sf).select(
        *KEYS,
        profile.alias("profile"),
        F.when(k % 3 == 0, sample).alias("sample"),
        F.when(k % 5 != 0, pointer).alias("pointer"),
    )
    packed = rows.select(*KEYS, style.package_style("profile", "sample", "pointer").alias("p"))
    empty = F.lit("")
    return packed.select(
        *KEYS,
        F.col("p").isNotNull().alias("packaged"),
        F.coalesce("p.profile.bulletStyle", empty).alias("bullet_style"),
        F.coalesce("p.sample.meta.role", empty).alias("sample_role"),
        F.coalesce("p.sample.rawText", empty).alias("sample_text"),
        F.coalesce("p.source.s3Key", empty).alias("source_key"),
    )


@query
def empty_resumes(spark, sf):
    rows = _generated(spark, sf).withColumn("resume", F.when(F.col("k") % 3 != 0, F.col("resume")))
    checked = validation.validate_resumes(rows).select(*KEYS, "status", F.explode("issues.code").alias("code"))
    return checked.where("code = 'EMPTY_RESUME'")


@query
def embed_texts(spark, sf):
    """Vectors by a column function in the place of a model: length and blanks of a text."""
    def model(text):
        blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
        return F.array(F.length(text), blanks).cast("array<float>")

    rows = embedding.embed(embedding.build_queries(jobs(spark, sf)), model, drop_empty=True)
    part = F.col("embedding")
    return rows.select(*KEYS, "query_no", part[0].cast("int").alias("n_chars"), part[1].cast("int").alias("blanks"))


@query
def upsert_vectors(spark, sf):
    """Every vector once, then every second one again; read back as the latest of each."""
    path = shared_dir(spark, "vectors")
    rows = table(spark, sf, "embeddings").select(
        F.concat(F.lit("t"), F.col("vec_id") % 3).alias("tenantId"),
        F.concat(F.lit("d"), "vec_id").alias("id"),
        F.lit("first").alias("text"),
        "embedding",
        "vec_id",
    )
    again = rows.where("vec_id % 2 = 0").withColumn("text", F.lit("second"))
    tables.upsert_vectors(rows.drop("vec_id"), path, F.lit(1).cast("long"))
    tables.upsert_vectors(again.drop("vec_id"), path, F.lit(2).cast("long"))
    return tables.vectors(spark, path).select("tenantId", "id", "text", "version")


@query
def generation_result(spark, sf):
    """Final answers of a batch: the good ones as results, the others as rejects."""
    k = F.col("k")
    entry = F.lit(', "changeLog": [{"type": "bullet", "detail": "d", "rationale": "r"}]')
    answer = F.concat(
        F.lit('{"tailoredResume": {"summary": "Resume '), k, F.lit('"}'),
        F.when(k % 3 == 0, entry).otherwise(""),
        F.lit(', "coverLetter": {"body": "Letter '), k, F.lit('"}}'),
    )
    rows = resume_corpus(spark, sf).select(*KEYS, "k", F.when(k % 10 == 0, "no answer").otherwise(answer).alias("raw"))
    good, bad = prompts.parse_model_json(rows, S.GENERATION)
    done = prompts.generation_result(good, include_cover=k % 2 == 0).select(
        *KEYS,
        "tailoredResume.summary",
        F.size("changeLog").alias("changes"),
        F.coalesce("coverLetter.body", F.lit("")).alias("letter"),
        F.lit("ok").alias("outcome"),
    )
    empty = F.lit("")
    return done.unionByName(
        bad.select(*KEYS, empty.alias("summary"), F.lit(0).alias("changes"), empty.alias("letter"), F.lit("reject").alias("outcome"))
    )


def _blanks_and_length(text):
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.array(F.length(text), blanks).cast("array<float>")


@query
def embed_once(spark, sf):
    """The vectors of ``embed_texts``, asked once per distinct text and found again by a second run."""
    store = shared_dir(spark, "vectors-by-text")
    queries = materialise(embedding.build_queries(jobs(spark, sf)), "queries")  # read by each batch of both runs
    embedding.embed(queries.where("query_no = 0"), _blanks_and_length, drop_empty=True, store=store)
    rows = embedding.embed(queries, _blanks_and_length, drop_empty=True, store=store, batches=2)
    part = F.col("embedding")
    return rows.select(*KEYS, "query_no", part[0].cast("int").alias("n_chars"), part[1].cast("int").alias("blanks"))


def _stand_in(prompt, _stop):
    """A model by rule: what it answers depends on the stage and the number in the prompt, and some answers are bad."""
    k, stage = F.regexp_extract(prompt, "#([0-9]+)#", 1), F.regexp_extract(prompt, "^[a-z_]+", 0)
    mark = F.concat(F.lit("#"), k, F.lit("#"))
    named = lambda name: F.concat(F.lit(f'{{"{name}": "'), mark, F.lit('"}'))
    n = k.try_cast("long")
    final = F.concat(F.lit('{"tailoredResume": {"summary": "Resume '), k, F.lit('"}}'))
    return (
        F.when((stage == "experience_alignment") & (n % 10 == 3), F.lit("I cannot do that"))
        .when((stage == "consistency_check") & (n % 7 == 2), F.concat(F.lit('{"tailoredResume": '), k))
        .when(stage == "consistency_check", final)
        .when(stage == "competency_extraction", F.concat(F.lit('{"competencies": [{"name": "'), mark, F.lit('"}]}')))
        .otherwise(named("plan"))
    )


@query
def generation_rejects(spark, sf):
    """Five stages over all resumes: finished jobs, and the stage whose answer ended each of the others."""
    variables = {
        "competency_extraction": "{jobDescription}", "experience_alignment": "{competencies} {retrievedChunks}",
        "bullet_rewrite": "{alignmentPlan} {options}", "skills_harmonization": "{bulletRewrites} {extractedSkills}",
        "consistency_check": "{skills} {styleGuide}",
    }
    rows = [(name, f"{name} {text}", ["</response>"]) for name, text in variables.items()]
    templates = spark.createDataFrame(rows, "name string, template string, stopSequences array<string>")
    none = lambda ddl: F.lit(None).cast(ddl)
    wanted = resume_corpus(spark, sf).select(
        *KEYS, F.struct(F.concat(F.lit("#"), "k", F.lit("#")).alias("title")).alias("job"), none(S.RESUME).alias("resume"),
        none("array<string>").alias("validated"), none(S.CHUNKS).alias("chunks"), none("array<string>").alias("skills"),
        none(S.STYLE_PROFILE).alias("profile"),
        none("struct<tone:string,length:string,keywords:array<string>,includeCoverLetter:boolean>").alias("options"),
        *[none("string").alias(f"out_{s}") for s in R.PROMPT_STAGES],
    )
    done, bad = prompts.generate_all(wanted, templates, _stand_in, shared_dir(spark, "answers"))
    finished = done.select(*KEYS, F.lit("finished").alias("outcome"), "tailoredResume.summary")
    return finished.unionByName(bad.select(*KEYS, F.col("stage").alias("outcome"), F.col("raw").alias("summary")))


# --- files ----------------------------------------------------------------

def _numbered_files(rows: DataFrame, path: str) -> None:
    """One file per row of (item_id, value), in a folder of its number."""
    rows.repartition("item_id").write.partitionBy("item_id").text(path)


@query
def file_documents(spark, sf):
    """Texts written as files, some of them no UTF-8, and pointers to them: what is found, and why the rest is not."""
    path, item = shared_dir(spark, "files"), F.col("item_id")
    items = table(spark, sf, "benchmark").select("item_id", "text")
    broken = F.concat(F.unhex(F.lit("FFFE")), F.col("text").cast("binary")).cast("string")
    _numbered_files(items.select("item_id", F.when(item % 5 == 4, broken).otherwise(F.col("text")).alias("value")), path)
    objects, unreadable = intake.read_text_objects(spark, path, "*.txt")
    folder = F.regexp_replace("key", "/[^/]*$", "")
    key = F.concat(F.lit("item_id="), item)
    pointer = F.struct(
        F.when(item % 7 != 6, key).alias("s3Key"), F.when(item % 7 == 3, F.concat(F.lit("inline "), item)).alias("text")
    )
    found, lost = intake.resolve_documents(items.select("item_id", pointer.alias("pointer")), objects.withColumn("key", folder))
    digest = F.sha2(F.rtrim("text", F.lit("\n")), 256)
    return (
        found.select("item_id", F.lit("found").alias("outcome"), digest.alias("text_sha256"))
        .unionByName(lost.select("item_id", F.col("reason").alias("outcome"), F.lit("").alias("text_sha256")))
        .unionByName(
            unreadable.select(F.substring_index(folder, "=", -1).cast("long").alias("item_id"), F.col("reason").alias("outcome"), F.lit("").alias("text_sha256"))
        )
    )


@query
def eval_inputs(spark, sf):
    """Evaluation inputs written as JSON files over several lines, some cut off or without a key, and read back."""
    jobs_at, resumes_at, item = shared_dir(spark, "jobs"), shared_dir(spark, "resumes"), F.col("item_id")
    items = table(spark, sf, "benchmark").select("item_id", "text")
    keys = [F.lit("t").alias("tenantId"), F.when(item % 11 != 7, F.concat(F.lit("j"), item)).alias("jobId")]

    def document(name):
        return F.to_json(F.struct(*keys, F.struct(F.col("text").alias("summary")).alias(name)), {"pretty": "true"})

    cut = F.expr("left(value, length(value) - 3)")
    written = items.select("item_id", document("job").alias("value"))
    _numbered_files(written.withColumn("value", F.when(item % 5 == 4, cut).otherwise(F.col("value"))), jobs_at)
    _numbered_files(items.where(item % 3 != 0).select("item_id", document("resume").alias("value")), resumes_at)
    rows, rejects = intake.load_eval_inputs(spark, jobs_at, resumes_at)
    good = rows.select("jobId", F.lit("input").alias("outcome"), F.length("job.summary").alias("chars"), F.size("chunks").alias("n"))
    bad = rejects.groupBy("kind", "reason").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return good.unionByName(bad.select(F.lit("").alias("jobId"), F.concat_ws(": ", "kind", "reason").alias("outcome"), F.lit(0).alias("chars"), "n"))


@query
def prompt_files(spark, sf):
    """Prompt templates written as one JSON object and read back."""
    path = shared_dir(spark, "prompts")
    entry = F.struct(F.col("n_name").alias("description"), F.concat(F.lit("Ask {"), "n_name", F.lit("}")).alias("template"),
                     F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("</r>"))).alias("stopSequences"))
    entries = F.collect_list(F.struct(F.concat(F.lit("prompt_"), "n_nationkey"), entry))
    table(spark, sf, "nation").agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.text(path)
    found = prompts.load_prompts(spark, path)
    return found.select("name", "description", "template", F.size("stopSequences").alias("stops"))


@query
def json_artifacts(spark, sf):
    """Artifacts of two runs, one of them written twice, as a reader finds them."""
    path, k = shared_dir(spark, "artifacts"), F.col("k")
    rows = resume_corpus(spark, sf).select(
        *KEYS, "k", F.concat(F.lit("log "), k).alias("changeLog"), F.when(k % 2 == 0, "style").alias("profile"),
        F.when(k % 3 == 0, "letter").alias("coverLetter"),
    )
    for run, part in (("first", rows), ("first", rows), ("second", rows.where("k % 4 = 0"))):
        tables.write_json_artifacts(part, path, run)
    kinds = [
        tables.read_json_artifacts(spark, path, kind).select("run", *KEYS, F.lit(kind).alias("kind"), F.col(kind).alias("body"))
        for kind in ("change_log", "style_profile", "cover_letter")
    ]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
