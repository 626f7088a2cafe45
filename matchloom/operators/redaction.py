"""Personal data: flags and redaction over text and nested columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as X


def pii_flags(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("has_email", X.has_email(text)).withColumn("has_phone", X.has_phone(text))


def redact_job(job: Column | str, redact: Callable[[Column], Column] = X.redact_patterns) -> Column:
    """Redact responsibilities, requirements and summary of a job description."""
    job = X.col(job)
    return (
        job.withField("responsibilities", F.transform(job["responsibilities"], redact))
        .withField("requirements", F.transform(job["requirements"], redact))
        .withField("summary", redact(job["summary"]))
    )


def redact_resume(resume: Column | str, redact: Callable[[Column], Column] = X.redact_patterns) -> Column:
    """Redact summary, achievements and project descriptions of a resume; nothing else."""
    resume = X.col(resume)
    return (
        resume.withField("summary", redact(resume["summary"]))
        .withField(
            "experience",
            F.transform(
                resume["experience"],
                lambda role: role.withField("achievements", F.transform(role["achievements"], redact)),
            ),
        )
        .withField(
            "projects",
            F.transform(resume["projects"], lambda p: p.withField("description", redact(p["description"]))),
        )
    )


def redact_jobs(
    df: DataFrame,
    enabled: Column | bool = False,
    redact: Callable[[Column], Column] = X.redact_patterns,
    job: str = "job",
    resume: str = "resume",
) -> DataFrame:
    """Redact both documents of each job for which ``enabled`` holds (off by default)."""
    on = enabled if isinstance(enabled, Column) else F.lit(enabled)
    return df.withColumn(job, F.when(on, redact_job(job, redact)).otherwise(F.col(job))).withColumn(
        resume, F.when(on, redact_resume(resume, redact)).otherwise(F.col(resume))
    )


def redact_with_entities(
    df: DataFrame, entities: DataFrame, keys: list[str], text: str = "text", out: str | None = None
) -> DataFrame:
    """Redact ``text`` by the spans an external detector found.

    ``entities`` has the keys and ``begin``/``end``; the spans of one text are
    collected next to it, so the list is bounded by the length of that text.
    """
    spans = entities.groupBy(*keys).agg(
        F.collect_list(F.struct(F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"))).alias("_spans")
    )
    return (
        df.join(spans, keys, "left").withColumn(out or text, X.redact_spans(text, "_spans")).drop("_spans")
    )
