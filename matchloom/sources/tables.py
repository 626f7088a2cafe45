"""Keyed tables: append-only change files, read as the latest row per key.

A writer only ever appends, so a retried task or micro-batch can at worst add the same
row again, and the latest row per key stays the same. ``compact`` rewrites a table into a
new folder when its history has grown.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import rules as R
from matchloom.functions.rows import explode_rows
from matchloom.session import materialise
from matchloom.sources.files import Files

STATUS_KEYS = ("tenantId", "jobId", "entityType")
VECTOR_KEYS = ("tenantId", "id")
FEEDBACK_KEYS = ("tenantId", "feedbackId")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by the ``order`` columns (they must tell all versions apart).

    ``max_by`` combines on the map side: a key with very many versions arrives at the
    shuffle as one row per task.
    """
    values = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*values), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table after inserting or replacing rows by key."""
    return latest(current.unionByName(changes, allowMissingColumns=True), keys, order)


def append_changes(df: DataFrame, path: str, partition: Sequence[str] = ("tenantId",)) -> None:
    df.write.mode("append").partitionBy(*partition).parquet(path)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return latest(reader.parquet(path), keys, order)


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str], order: Sequence[str], partition: Sequence[str] = ("tenantId",)) -> None:
    """Write only the latest rows to a new folder ``target``."""
    read_latest(spark, path, keys, order).write.mode("errorifexists").partitionBy(*partition).parquet(target)


def upsert_vectors(df: DataFrame, path: str, version: Column | None = None) -> None:
    """Insert or replace vectors by document id (see :func:`vectors`)."""
    stamped = df.withColumn("version", F.unix_micros(F.current_timestamp()) if version is None else version)
    append_changes(stamped, path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    # rows of one version are told apart by their text and vector
    rows = spark.read.parquet(path).withColumn("_digest", F.xxhash64("embedding"))
    return latest(rows, VECTOR_KEYS, ("version", "text", "_digest")).drop("_digest")


# --- job status -----------------------------------------------------------

def status_rows(jobs: DataFrame, status: str = "RUNNING", at: Column | None = None) -> DataFrame:
    return jobs.select(
        "tenantId",
        "jobId",
        F.lit("STATUS").alias("entityType"),
        F.lit(status).alias("status"),
        (F.unix_timestamp() if at is None else at).alias("updatedAt"),
        F.lit(None).cast("string").alias("artifacts"),
    )


def result_rows(manifest: DataFrame, at: Column | None = None) -> DataFrame:
    """RESULT rows of finished jobs; ``manifest`` has one artifact struct per job."""
    return manifest.select(
        "tenantId",
        "jobId",
        F.lit("RESULT").alias("entityType"),
        F.lit("COMPLETED").alias("status"),
        (F.unix_timestamp() if at is None else at).alias("updatedAt"),
        F.to_json("artifacts", {"ignoreNullFields": "false"}).alias("artifacts"),
    )


def current_job_status(jobs: DataFrame, status: DataFrame, raw: bool = False) -> DataFrame:
    """Status of each asked job: its RESULT row if any, else its STATUS row, else UNKNOWN.

    ``raw=True`` looks at STATUS rows only.
    """
    per_job = status.groupBy("tenantId", "jobId").agg(
        F.max_by(F.when(F.col("entityType") == "STATUS", F.col("status")), F.when(F.col("entityType") == "STATUS", F.struct("updatedAt", "status"))).alias("_status"),
        F.max_by(F.when(F.col("entityType") == "RESULT", F.col("status")), F.when(F.col("entityType") == "RESULT", F.struct("updatedAt", "status"))).alias("_result"),
    )
    best = F.col("_status") if raw else F.coalesce("_result", "_status")
    return (
        jobs.select("tenantId", "jobId")
        .join(per_job, ["tenantId", "jobId"], "left")
        .select("tenantId", "jobId", F.coalesce(best, F.lit("UNKNOWN")).alias("status"))
    )


def stuck_jobs(status: DataFrame, now: Column, limit: int = R.STUCK_AFTER_SECONDS) -> DataFrame:
    """Jobs whose latest STATUS is RUNNING for longer than the limit and that have no RESULT row.

    A later FAILED ends a job as a RESULT does. Both are found in one aggregate per job.
    """
    is_status = F.col("entityType") == "STATUS"
    per_job = status.groupBy("tenantId", "jobId").agg(
        F.max(F.when(is_status, F.struct("updatedAt", "status"))).alias("_last"),
        F.max(F.col("entityType") == "RESULT").alias("_done"),
    )
    stuck = (F.col("_last.status") == "RUNNING") & (F.col("_last.updatedAt") < now - limit)
    return per_job.where(~F.coalesce("_done", F.lit(False)) & stuck).select("tenantId", "jobId", F.col("_last.updatedAt").alias("updatedAt"))


# --- artifacts ------------------------------------------------------------

def artifact_manifest(
    jobs: DataFrame, at: Column, ttl_days: int = R.ARTIFACT_TTL_DAYS, profile: str = "profile",
    cover_letter: str = "coverLetter", style_source: str = "styleSource",
) -> DataFrame:
    """(tenantId, jobId, artifacts): the keys below ``tenant/job/epoch/`` and when they expire.

    Columns that a job table lacks count as absent.
    """
    def col(name):
        return F.col(name) if name in jobs.columns else F.lit(None).cast("string")

    epoch = at.cast("long")
    prefix = F.concat_ws("/", "tenantId", "jobId", epoch.cast("string"))

    def key(name):
        return F.concat(prefix, F.lit(f"/{name}"))

    artifacts = F.struct(
        key("tailored_resume.docx").alias("docxKey"),
        key("tailored_resume.pdf").alias("pdfKey"),
        key("change_log.json").alias("changeLogKey"),
        F.when(col(cover_letter).isNotNull(), key("cover_letter.json")).alias("coverLetterKey"),
        F.when(col(profile).isNotNull(), key("style_profile.json")).alias("styleProfileKey"),
        col(style_source).alias("styleSourceKey"),
        (epoch + ttl_days * 86400).alias("expiresAt"),
    )
    return jobs.select("tenantId", "jobId", artifacts.alias("artifacts"))


def manifest_keys(manifest: DataFrame) -> DataFrame:
    """Long form: one row per stored object (the style source is the caller's own file)."""
    names = ("docxKey", "pdfKey", "changeLogKey", "coverLetterKey", "styleProfileKey")
    keys = F.array_compact(F.array(*[F.col(f"artifacts.{n}") for n in names]))
    return explode_rows(manifest, ["tenantId", "jobId", F.col("artifacts.expiresAt").alias("expiresAt")], keys, "key")


def list_artifacts(objects: DataFrame, tenant: str, job: str | None = None) -> DataFrame:
    """Keys of a tenant, or of one job of it: equality on columns, pruned by partition."""
    df = objects.where(F.col("tenantId") == tenant)
    if job is not None:
        df = df.where(F.col("jobId") == job)
    return df.select("key")


def expired_artifacts(
    objects: DataFrame, now: Column, ttl_days: int = R.ARTIFACT_TTL_DAYS, modified: str = "lastModified"
) -> DataFrame:
    """Objects last changed before ``now`` less the time to live (strictly)."""
    return objects.where(F.col(modified) < now - ttl_days * 86400)


def surviving_artifacts(
    objects: DataFrame, now: Column, ttl_days: int = R.ARTIFACT_TTL_DAYS, modified: str = "lastModified"
) -> DataFrame:
    return objects.where(F.col(modified).isNull() | (F.col(modified) >= now - ttl_days * 86400))


def write_objects(objects: DataFrame, path: str, modified: str = "lastModified") -> None:
    """Append object rows below ``path``, by tenant and day of their last change (seconds since 1970)."""
    day = F.to_date(F.timestamp_seconds(modified))
    objects.withColumn("day", day).write.mode("append").partitionBy("tenantId", "day").parquet(path)


def prune_objects(spark: SparkSession, path: str, now: int, ttl_days: int = R.ARTIFACT_TTL_DAYS, modified: str = "lastModified") -> int:
    """Take expired rows out of the folder of ``write_objects``; returns how many.

    Only partitions up to the day of the limit are read. Those that keep rows are written again by dynamic partition
    overwrite, those that keep none are deleted. A second run, or one after a crash, finds what is still to be done.
    """
    limit = F.lit(now - ttl_days * 86400)
    old = spark.read.parquet(path).where(F.col("day") <= F.to_date(F.timestamp_seconds(limit)))
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
    counts = old.groupBy("tenantId", "day", folder.alias("folder")).agg(
        F.count_if(F.col(modified) < limit).alias("expired"), F.count(F.lit(1)).alias("n")
    )
    touched = counts.where("expired > 0").collect()  # a row per partition, as many as the reader lists anyway
    mixed = [r for r in touched if r.expired < r.n]
    if mixed:
        wanted = spark.createDataFrame([(r.tenantId, r.day) for r in mixed], old.select("tenantId", "day").schema)
        same = old["tenantId"].eqNullSafe(wanted["tenantId"]) & (old["day"] == wanted["day"])
        left = materialise(old.join(F.broadcast(wanted), same, "left_semi").where(F.col(modified) >= limit), "survivors")
        left = left.repartition("tenantId", "day")
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenantId", "day").parquet(path)
    files = Files(spark, path)
    for r in touched:
        if r.expired == r.n:
            files.delete_uri(r.folder)
    return sum(r.expired for r in touched)


_RUNS = "_runs"


def write_json_artifacts(
    jobs: DataFrame, path: str, run: str, change_log: str = "changeLog", profile: str = "profile", cover_letter: str = "coverLetter"
) -> bool:
    """JSON artifacts below ``path/<kind>/run=<run>/tenantId=.../``: the change log always, the others when present.

    A run counts once its name stands below ``path/_runs``; then it is not written again (False). What a run that broke
    off has left is replaced by the next one of its name, and read by nobody before.
    """
    files = Files(jobs.sparkSession, path)
    if run in files.names(_RUNS):
        return False
    for kind, column, always in (
        ("change_log", change_log, True), ("style_profile", profile, False), ("cover_letter", cover_letter, False)
    ):
        rows = jobs.select("tenantId", "jobId", F.col(column).alias(kind))
        if not always:
            rows = rows.where(F.col(kind).isNotNull())
        rows.write.mode("overwrite").partitionBy("tenantId").json(f"{path.rstrip('/')}/{kind}/run={run}")
    return files.write_new(_RUNS, run, b"")


def read_json_artifacts(spark: SparkSession, path: str, kind: str, ddl: str = "string") -> DataFrame:
    """(run, tenantId, jobId, ``kind``) of all runs that were written to the end."""
    schema = f"jobId string, `{kind}` {ddl}, tenantId string"
    frames = [
        spark.read.schema(schema).json(f"{path.rstrip('/')}/{kind}/run={run}").withColumn("run", F.lit(run))
        for run in sorted(Files(spark, path).names(_RUNS))
        if not run.startswith(".")
    ]
    if not frames:
        return spark.createDataFrame([], f"run string, tenantId string, jobId string, `{kind}` {ddl}")
    return reduce(DataFrame.unionByName, frames).select("run", "tenantId", "jobId", kind)
