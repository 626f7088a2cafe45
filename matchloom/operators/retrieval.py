"""Retrieval context of a job: neighbours, feedback, best chunk per text, top 20, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom import rules as R
from matchloom.functions import text as X
from matchloom.operators.coverage import add_chunk_coverage
from matchloom.operators.matching import nearest

KEYS = ("tenantId", "jobId")


def scan_feedback(feedback: DataFrame, tenant: str | None = None, job: str | None = None) -> DataFrame:
    """Feedback rows of a job, or of all jobs: id prefix ``<job>#``, defaults filled in.

    Given as literals, both conditions are pushed down to the file scan.
    """
    df = feedback
    if tenant is not None:
        df = df.where(F.col("tenantId") == tenant)
    if job is not None:
        df = df.where(F.col("feedbackId").startswith(f"{job}#"))
        jobs = F.array(F.lit(job))
    else:
        # every prefix before a '#' names a job this row belongs to; nearly always there is one
        marks = X.count_char(F.col("feedbackId"), "#")
        jobs = F.when(
            marks > 0, F.transform(F.sequence(F.lit(1), marks), lambda i: F.call_function("substring_index", F.col("feedbackId"), F.lit("#"), i))
        )
    return df.withColumn("jobId", F.explode(jobs)).select(
        "tenantId",
        "jobId",
        "feedbackId",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def dedup_best(chunks: DataFrame, keys: Sequence[str] = KEYS, arrival: str = "arrival", payload: Sequence[str] = ()) -> DataFrame:
    """Per (keys, text) the row of best score, the earliest on ties, and where the text was first seen.

    One aggregate with map-side combine (a minimum over (-score, arrival, payload)) by a 256-bit hash of the text: a
    text with very many copies arrives at the shuffle as one row per task, and texts are not compared with each other.
    """
    fields = ((-F.col("score")).alias("neg"), F.col(arrival).alias("arrival"), *payload, F.col("text").alias("_text"))
    return (
        chunks.groupBy(*keys, F.sha2("text", 256).alias("_same"))
        .agg(F.min(F.struct(*fields)).alias("best"), F.min(arrival).alias("first_seen"))
        .select(*keys, F.col("best._text").alias("text"), (-F.col("best.neg")).alias("score"), "first_seen", *[f"best.{p}" for p in payload])
    )


def top_chunks(deduped: DataFrame, keys: Sequence[str] = KEYS, n: int = R.KEPT_CHUNKS) -> DataFrame:
    """The ``n`` best chunks per key, ties by first appearance (stable), numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("first_seen"))
    return deduped.withColumn("chunk_no", F.row_number().over(order)).where(F.col("chunk_no") <= n)


def search_hits(
    queries: DataFrame, vectors: DataFrame, k: int = R.NEIGHBOURS, cross_tenant: bool = False
) -> DataFrame:
    """Neighbours of each job query with text and metadata.

    ``queries``: (tenantId, jobId, query_no, embedding). ``vectors``: (tenantId, id, text, metadata,
    embedding). Only the tenant's own vectors are searched unless ``cross_tenant``.
    """
    asked = queries.withColumn("query_id", F.concat_ws("\x1f", "tenantId", "jobId", F.col("query_no").cast("string")))
    stored = vectors.withColumn("doc_id", F.col("id"))
    keys = () if cross_tenant else ("tenantId",)
    hits = nearest(asked, stored, k, keys)
    part = F.split("query_id", "\x1f")
    named = hits.select(
        part[0].alias("tenantId"),
        part[1].alias("jobId"),
        part[2].cast("int").alias("query_no"),
        "rank",
        "score",
        F.col("doc_id").alias("id"),
    )
    texts = vectors.select(
        *([] if cross_tenant else ["tenantId"]),
        "id",
        F.coalesce("text", F.lit("")).alias("text"),
        "metadata",
    )
    return named.join(texts, ["id"] if cross_tenant else ["tenantId", "id"])


def retrieve_context(
    queries: DataFrame,
    vectors: DataFrame,
    feedback: DataFrame | None = None,
    k: int = R.NEIGHBOURS,
    n: int = R.KEPT_CHUNKS,
    cross_tenant: bool = False,
) -> DataFrame:
    """Chunks of each job: (tenantId, jobId, chunk_no, text, score, id, metadata, tags).

    Arrival order is (query number, hit rank); feedback of the job comes last, by id.
    """
    # zero padded so that the arrival order is the string order
    seen = F.format_string("q%010d#%010d", F.col("query_no"), F.col("rank"))
    chunks = search_hits(queries, vectors, k, cross_tenant).select(
        *KEYS, "text", "score", seen.alias("arrival"), "id", F.to_json("metadata").alias("metadata"),
        F.lit(None).cast("array<string>").alias("tags"),
    )
    if feedback is not None:
        wanted = queries.select(*KEYS).distinct()
        noted = scan_feedback(feedback).join(wanted, list(KEYS), "left_semi")
        chunks = chunks.unionByName(
            noted.select(
                *KEYS, "text", "score", F.concat(F.lit("r#"), "feedbackId").alias("arrival"),
                F.col("feedbackId").alias("id"), F.lit(None).cast("string").alias("metadata"), "tags",
            )
        )
    best = dedup_best(chunks, KEYS, payload=("id", "metadata", "tags"))
    return top_chunks(best, KEYS, n).select(
        *KEYS, "chunk_no", "text", F.round("score", 4).alias("score"), "id",
        F.from_json("metadata", "map<string,string>").alias("metadata"), "tags",
    )


def collect_chunks(chunks: DataFrame) -> DataFrame:
    """One row per job with its (at most 20) chunks in order."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_no", "text", "score")))
    return chunks.groupBy(*KEYS).agg(ordered.alias("_c")).select(
        *KEYS,
        F.transform("_c", lambda c: F.struct(c["text"].alias("text"), c["score"].alias("score"))).alias("chunks"),
    )


def with_coverage(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add each job's chunks and their coverage of its description."""
    empty = F.array().cast("array<struct<text:string,score:double>>")
    joined = jobs.join(collect_chunks(chunks), list(KEYS), "left").withColumn("chunks", F.coalesce("chunks", empty))
    return add_chunk_coverage(joined, F.col("chunks.text"))
