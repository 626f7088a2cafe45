"""Uploads, requests and document texts: from raw rows to parse-ready rows plus rejects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import schemas as S
from matchloom.functions import text as X
from matchloom.functions.rows import inline_rows


def _column(df: DataFrame, name: str, ddl: str) -> Column:
    """The column, or a null of its type when the table does not have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(ddl)


def ingest_uploads(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of uploads (tenantId, kind, content_b64, extension, contentType, metadata).

    The object key is ``tenant/kind/<sha-256 of the content>.<extension>``, so a second run writes
    the same keys. Rejected: no tenant, no content, content that is not base64.
    """
    staged = (
        df.withColumn("content", F.try_to_binary("content_b64", F.lit("base64")))
        .withColumn(
            "reason",
            F.when(F.coalesce("tenantId", F.lit("")) == "", "tenantId is required")
            .when(F.coalesce("content_b64", F.lit("")) == "", "content is required")
            .when(F.col("content").isNull(), "content is not base64"),
        )
    )
    extension = F.coalesce(_column(df, "extension", "string"), F.lit("txt"))
    key = F.concat_ws("/", "tenantId", "kind", F.concat(F.sha2("content", 256), F.lit("."), extension))
    documents = staged.where(F.col("reason").isNull()).select(
        "tenantId",
        "kind",
        key.alias("key"),
        "content",
        F.coalesce(_column(df, "contentType", "string"), F.lit("application/octet-stream")).alias("contentType"),
        _column(df, "metadata", S.METADATA).alias("metadata"),
    )
    rejects = staged.where(F.col("reason").isNotNull()).drop("content")
    # equal contents of a tenant and kind are one object
    return documents.dropDuplicates(["key"]), rejects


def write_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("append").partitionBy("tenantId", "kind").parquet(path)


def upload_metadata(documents: DataFrame, created_at: Column | None = None) -> DataFrame:
    """One UPLOAD row per key; the caller's metadata may override ``kind``."""
    given = F.coalesce("metadata", F.create_map().cast(S.METADATA))
    kind = F.create_map(F.lit("kind"), F.col("kind"))
    merged = F.map_concat(F.map_filter(kind, lambda k, v: ~F.map_contains_key(given, "kind")), given)
    return documents.select(
        F.concat_ws("#", "tenantId", "key").alias("tenantJobId"),
        F.lit("UPLOAD").alias("entityType"),
        F.to_json(merged).alias("metadata"),
        (F.unix_timestamp() if created_at is None else created_at).alias("createdAt"),
    )


def normalise_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pipeline inputs, rejects) from request rows.

    An explicit ``executionInput`` wins over the single columns; ``styleGuide`` wins over its key
    columns; a missing job id is a hash of the request, the same in every pass. Both documents need a key or a text.
    """
    pointer = S.DOCUMENT_POINTER

    def by_key(key: Column, metadata: Column | None = None, kind: Column | None = None) -> Column:
        return F.struct(
            key.alias("s3Key"),
            F.lit(None).cast("string").alias("text"),
            (metadata if metadata is not None else F.lit(None)).cast(S.METADATA).alias("metadata"),
            (kind if kind is not None else F.lit(None)).cast("string").alias("documentType"),
        ).cast(pointer)

    has_input = "executionInput" in df.columns
    given = df.schema["executionInput"].dataType.fieldNames() if has_input else []

    def explicit(name: str, ddl: str) -> Column:
        return F.col(f"executionInput.{name}").cast(ddl) if name in given else F.lit(None).cast(ddl)

    def chosen(name: str, ddl: str, otherwise: Column) -> Column:
        if not has_input:
            return otherwise
        return F.when(F.col("executionInput").isNotNull(), explicit(name, ddl)).otherwise(otherwise)

    style_key = _column(df, "styleGuideKey", "string")
    style = F.coalesce(
        _column(df, "styleGuide", pointer).cast(pointer),
        F.when(
            X.nonempty(style_key).isNotNull(),
            by_key(
                style_key,
                _column(df, "styleGuideMetadata", S.METADATA),
                X.nonempty(_column(df, "styleGuideDocumentType", "string")),
            ),
        ),
        explicit("styleGuide", pointer),
    )
    own_options = df.schema["options"].dataType.simpleString() if "options" in df.columns else None
    inner = dict(zip(given, df.schema["executionInput"].dataType.fields)) if has_input else {}
    options_ddl = own_options or (inner["options"].dataType.simpleString() if "options" in inner else "struct<tone:string>")
    options = chosen("options", options_ddl, _column(df, "options", options_ddl))
    hashed = F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    as_uuid = F.regexp_replace(hashed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    job_id = F.coalesce(X.nonempty(_column(df, "jobId", "string")), as_uuid)
    out = df.select(
        "tenantId",
        F.coalesce(chosen("jobId", "string", job_id), job_id).alias("jobId"),
        chosen("jobDescription", pointer, by_key(_column(df, "jobDescriptionKey", "string"))).alias("jobDescription"),
        chosen("baseResume", pointer, by_key(_column(df, "baseResumeKey", "string"))).alias("baseResume"),
        chosen(
            "validatedResumes",
            f"array<{pointer}>",
            F.coalesce(
                _column(df, "validatedResumes", f"array<{pointer}>").cast(f"array<{pointer}>"),
                F.array().cast(f"array<{pointer}>"),
            ),
        ).alias("validatedResumes"),
        options.alias("options"),
        style.alias("styleGuide"),
    )

    def present(name: str) -> Column:
        return F.coalesce(X.nonempty(F.col(f"{name}.s3Key")), X.nonempty(F.col(f"{name}.text"))).isNotNull()

    reason = F.when(F.coalesce("tenantId", F.lit("")) == "", "tenantId is required").when(
        ~(present("jobDescription") & present("baseResume")), "jobDescription and baseResume inputs are required"
    )
    judged = out.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


REQUIRED_FIELDS = ("tenantId", "jobId", "jobDescription", "baseResume")


def validate_requests(df: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(complete rows, quarantined rows with ``missing``): all missing fields are named.

    ``validatedResumes`` must be an array column when it is there.
    """
    if "validatedResumes" in df.columns and df.schema["validatedResumes"].dataType.typeName() != "array":
        raise ValueError("validatedResumes must be a list if provided")
    absent = [F.when(_column(df, f, "string").isNull(), F.lit(f)) for f in required]
    judged = df.withColumn("missing", F.array_compact(F.array(*absent)))
    return judged.where(F.size("missing") == 0).drop("missing"), judged.where(F.size("missing") > 0)


def request_documents(requests: DataFrame) -> DataFrame:
    """Long form of the document pointers: (tenantId, jobId, role, idx, pointer)."""
    single = F.array(
        F.struct(F.lit("job").alias("role"), F.lit(0).alias("idx"), F.col("jobDescription").alias("pointer")),
        F.struct(F.lit("base").alias("role"), F.lit(0).alias("idx"), F.col("baseResume").alias("pointer")),
        F.struct(F.lit("style").alias("role"), F.lit(0).alias("idx"), F.col("styleGuide").alias("pointer")),
    )
    validated = F.transform(
        "validatedResumes", lambda p, i: F.struct(F.lit("validated").alias("role"), i.alias("idx"), p.alias("pointer"))
    )
    rows = inline_rows(requests, ["tenantId", "jobId"], F.concat(single, validated))
    return rows.where(F.col("pointer").isNotNull())


def resolve_documents(pointers: DataFrame, objects: DataFrame, pointer: str = "pointer") -> tuple[DataFrame, DataFrame]:
    """(rows with ``text``, rejects). Inline text wins; else the object of the key, decoded as UTF-8.

    ``objects``: (key, content). Rows with inline text skip the join, so their null keys do not
    pile up in one partition.
    """
    inline = X.nonempty(F.col(f"{pointer}.text"))
    with_text = pointers.where(inline.isNotNull()).withColumn("text", F.col(f"{pointer}.text"))
    by_key = (
        pointers.where(inline.isNull() & F.col(f"{pointer}.s3Key").isNotNull())
        .withColumn("_key", F.col(f"{pointer}.s3Key"))
        .join(
            objects.dropDuplicates(["key"]).select(F.col("key").alias("_key"), F.decode("content", "UTF-8").alias("text")),
            "_key",
            "left",
        )
        .drop("_key")
    )
    nowhere = pointers.where(inline.isNull() & F.col(f"{pointer}.s3Key").isNull())
    found = with_text.unionByName(by_key.where(F.col("text").isNotNull()))
    rejects = (
        nowhere.withColumn("reason", F.lit("document pointer must include either text or s3Key"))
    ).unionByName(
        by_key.where(F.col("text").isNull()).drop("text").withColumn("reason", F.lit("object not found"))
    )
    return found, rejects


def assemble_blocks(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Text of each document from its recognised blocks (seq, blockType, text) in order."""
    kept = blocks.where(F.col("blockType").isin("LINE", "CELL") & (F.coalesce("text", F.lit("")) != ""))
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("_b")).select(
        *keys, F.array_join(F.transform("_b", lambda b: b["text"]), "\n").alias("text")
    )


def read_text_objects(spark: SparkSession, path: str, names: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, rejects) of the files below ``path``: (key, content); the key is the path below the root.

    ``names`` is a pattern of file names that the reader lists only. A file that is not UTF-8 is a reject (key, reason).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", names) if names else reader).load(path)
    root = path.rstrip("/") + "/"
    rows = files.select(F.substring_index(F.col("path"), root, -1).alias("key"), "content")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return rows.where(valid), rows.where(~valid).select("key", F.lit("not UTF-8").alias("reason"))


def _json_files(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files with one JSON document each."""
    rows = (
        spark.read.schema(f"tenantId string, jobId string, {ddl}, _corrupt string")
        .option("recursiveFileLookup", "true")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path, multiLine=True)
        .withColumn("file", F.col("_metadata.file_name"))
    )
    # named in the schema and read, the column tells which files could not be parsed
    bad = F.col("_corrupt").isNotNull() | F.col("tenantId").isNull() | F.col("jobId").isNull()
    reason = F.when(F.col("_corrupt").isNotNull(), "no valid JSON").otherwise("tenantId and jobId are required")
    return rows.where(~bad).drop("_corrupt", "file"), rows.where(bad).select("file", reason.alias("reason"))


def load_eval_inputs(
    spark: SparkSession, jobs: str, resumes: str, retrieval: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows to score, rejects): (tenantId, jobId, job, resume, chunks) from JSON files; chunks default to none.

    A file without a document, or whose document lacks its keys, is a reject (kind, file, reason).
    """
    job, bad_jobs = _json_files(spark, jobs, f"job {S.JOB_DESCRIPTION}")
    resume, bad_resumes = _json_files(spark, resumes, f"resume {S.RESUME}")
    joined = job.join(resume, ["tenantId", "jobId"])
    rejects = bad_jobs.withColumn("kind", F.lit("job")).unionByName(bad_resumes.withColumn("kind", F.lit("resume")))
    none = F.array().cast(S.CHUNKS)
    if retrieval is None:
        return joined.withColumn("chunks", none), rejects
    chunks, bad = _json_files(spark, retrieval, f"chunks {S.CHUNKS}")
    rows = joined.join(chunks, ["tenantId", "jobId"], "left").withColumn("chunks", F.coalesce("chunks", none))
    return rows, rejects.unionByName(bad.withColumn("kind", F.lit("retrieval")))
