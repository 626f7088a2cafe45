"""Skill lists -> counted skills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom import rules as R
from matchloom.functions import text as X
from matchloom.functions.rows import explode_rows, inline_rows

JOB_KEYS = ("tenantId", "jobId")


def derive_skills(df: DataFrame, text: str = "text", out: str = "skills") -> DataFrame:
    """Add the capitalised words of a text as sorted distinct skills."""
    return df.withColumn(out, X.skill_words(text))


def skill_lists(jobs: DataFrame, validated: DataFrame | None = None, keys: Sequence[str] = JOB_KEYS) -> DataFrame:
    """One row per (job, source document) with its skill array.

    ``jobs`` holds ``job`` and ``resume``; ``validated`` holds ``idx`` and ``resume``. The source
    of a validated resume is its key, or ``validated-<idx>`` when it has none.
    """
    own = inline_rows(
        jobs,
        keys,
        F.array(
            F.struct(F.lit("job").alias("source"), F.col("job.skills").alias("skills")),
            F.struct(F.lit("base").alias("source"), F.col("resume.skills").alias("skills")),
        ),
    )
    if validated is None:
        return own
    return own.unionByName(
        validated.select(*keys, validated_source("resume", "idx").alias("source"), F.col("resume.skills").alias("skills"))
    )


def validated_source(resume: str, idx: str):
    return F.coalesce(F.col(f"{resume}.meta.sourceKey"), F.concat(F.lit("validated-"), F.col(idx).cast("string")))


def aggregate_skills(lists: DataFrame, keys: Sequence[str] = JOB_KEYS) -> DataFrame:
    """Count skills per key: (keys, skill, sources, frequency).

    Counts per (key, skill, source) first: that step combines on the map side, so a skill
    that fills a third of all rows reaches the second step as one row per source.
    """
    per_source = (
        explode_rows(lists, [*keys, "source"], "skills", "_raw")
        .withColumn("skill", X.strip(F.lower("_raw")))
        .where(F.col("skill") != "")
        .groupBy(*keys, "skill", "source")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_source.groupBy(*keys, "skill").agg(
        F.sort_array(F.collect_list("source")).alias("sources"), F.sum("n").alias("frequency")
    )


def rank_skills(skills: DataFrame, keys: Sequence[str] = JOB_KEYS) -> DataFrame:
    """Number the skills of each job from 0: most frequent first, then by name."""
    order = Window.partitionBy(*keys).orderBy(F.desc("frequency"), F.asc("skill"))
    return skills.withColumn("skill_no", F.row_number().over(order) - 1)
