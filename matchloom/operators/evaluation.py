"""Quality scores of a finished resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import rules as R
from matchloom.functions import text as X
from matchloom.functions.rows import settle
from matchloom.operators import coverage as C
from matchloom.operators.parsing import all_bullets


def _allowed(mean: Column) -> Column:
    return F.greatest(mean * R.CONSISTENCY_SHARE, F.lit(R.CONSISTENCY_MIN))


def add_consistency(df: DataFrame, bullets: Column, out: str = "consistency") -> DataFrame:
    """Add the share of bullets whose word count lies near the mean; 0 without bullets."""
    staged = settle(df, _lengths=X.word_counts(bullets))
    n = F.size("_lengths")
    total = F.aggregate("_lengths", F.lit(0), lambda a, x: a + x)
    staged = settle(staged, _n=n, _mean=F.when(n > 0, total / n))
    far = F.size(F.filter("_lengths", lambda x: F.abs(x - F.col("_mean")) > _allowed(F.col("_mean"))))
    share = F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.round(1.0 - far / F.col("_n"), 3))
    return staged.withColumn(out, share).drop("_lengths", "_n", "_mean")


def bullet_consistency(bullets: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Long form: (keys, bullets, near, consistency) over one bullet per row.

    Bullets are first counted by (keys, length), which combines on the map side; the mean and
    the second look then work on one row per distinct length, however large the key.
    """
    keys = list(keys)
    by_length = (
        bullets.select(*keys, X.word_count(text).alias("len")).groupBy(*keys, "len").agg(F.count(F.lit(1)).alias("n"))
    )
    means = by_length.groupBy(*keys).agg((F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("mean"))
    near = F.when(F.abs(F.col("len") - F.col("mean")) <= _allowed(F.col("mean")), F.col("n")).otherwise(0)
    return (
        by_length.join(means, keys)
        .groupBy(*keys)
        .agg(F.sum("n").alias("bullets"), F.sum(near).alias("near"))
        .withColumn("consistency", F.round(F.col("near") / F.col("bullets"), 3))
    )


def readability(df: DataFrame, text: str = "text") -> DataFrame:
    """Add words, sentences, syllables and grade of a text."""
    return (
        df.withColumn("words", X.word_count(text))
        .withColumn("sentences", X.sentence_count(text))
        .withColumn("syllables", X.syllable_count(text))
        .withColumn("grade", X.grade_from_counts(F.col("words"), F.col("sentences"), F.col("syllables")))
    )


def prepare_jobs(df: DataFrame, job: str = "job", out: str = "wanted") -> DataFrame:
    """Add what ``evaluate`` reads of a job description: targets and keywords with their tokens, and the texts that count
    as evidence. Made before descriptions meet the resumes that answer them, it is made once per description."""
    staged = settle(df, **{job: F.col(job)})
    staged = settle(staged, _targets=C.jd_targets(job), _keywords=C.jd_keywords(job))
    wanted = F.struct(
        C.with_tokens("_targets").alias("targets"),
        C.with_tokens("_keywords").alias("keywords"),
        C.evidence_text(job, F.array().cast("array<string>")).alias("evidence"),
    )
    return settle(staged, **{out: wanted}).drop("_targets", "_keywords")


def evaluate(
    df: DataFrame, job: str = "job", resume: str = "resume", chunks: str | None = "chunks", wanted: str | None = None
) -> DataFrame:
    """Add the quality report of each row's job description and resume.

    ``chunks`` is an array of structs with ``text`` (or None). All parts come from the row itself:
    one projection, no join. Integer hits and totals stand next to the rounded scores. ``wanted`` names the column of
    ``prepare_jobs`` if the rows have one; it is made here otherwise.
    """
    chunk_texts = (
        F.coalesce(F.col(f"{chunks}.text"), F.array().cast("array<string>"))
        if chunks
        else F.array().cast("array<string>")
    )
    staged = df if wanted else prepare_jobs(df, job, "_wanted")
    staged = settle(staged, _wanted=F.col(wanted or "_wanted"), **{resume: F.col(resume)})
    staged = settle(
        staged,
        _have=F.concat(F.lit(" "), X.token_text(C.resume_text(resume)), F.lit(" ")),
        _bullets=all_bullets(resume),
        _evidence=F.concat(F.lower(X.joined(chunk_texts)), F.lit(X.JOINT), F.col("_wanted.evidence")),
    )
    staged = settle(
        staged,
        missingCoverageTargets=C.missing_targets("_wanted.targets", "_have"),
        missingAtsKeywords=C.missing_targets("_wanted.keywords", "_have"),
        hallucinations=C.unsupported_bullets("_bullets", "_evidence"),
        _targets=F.size("_wanted.targets"),
        _keywords=F.size("_wanted.keywords"),
        _text=F.concat_ws(" ", F.coalesce(F.col(f"{resume}.summary"), F.lit("")), "_bullets"),
    )
    staged = add_consistency(staged, F.col("_bullets"))
    staged = settle(staged, _folded=X.folded_words("_text"), _sentences=X.sentence_count("_text"))
    staged = settle(staged, _words=X.words_in(F.col("_folded")), _syllables=X.syllables_in(F.col("_folded")))
    return (
        staged.withColumn("targets", F.col("_targets"))
        .withColumn("targetHits", F.col("_targets") - F.size("missingCoverageTargets"))
        .withColumn("keywords", F.col("_keywords"))
        .withColumn("keywordHits", F.col("_keywords") - F.size("missingAtsKeywords"))
        .withColumn("jdCoverage", C.score(F.col("targetHits"), F.col("targets")))
        .withColumn("atsKeywordScore", C.score(F.col("keywordHits"), F.col("keywords")))
        .withColumn(
            "readabilityGradeLevel",
            X.grade_from_counts(F.col("_words"), F.col("_sentences"), F.col("_syllables")),
        )
        .drop("_wanted", "_have", "_targets", "_keywords", "_bullets", "_evidence", "_text", "_folded", "_words", "_sentences", "_syllables")
    )


def quality_gate(report: DataFrame, resume: str = "resume", override: Column | None = None) -> DataFrame:
    """Add ``passed``: coverage and keyword scores high enough, nothing unsupported, not too long
    (unless ``override``)."""
    words = X.word_count(C.resume_text(resume))
    short = words <= R.GATE_WORDS
    if override is not None:
        short = short | F.coalesce(override, F.lit(False))
    return report.withColumn("words", words).withColumn(
        "passed",
        (F.col("jdCoverage") >= R.GATE_COVERAGE)
        & (F.col("atsKeywordScore") >= R.GATE_KEYWORDS)
        & (F.size("hallucinations") == 0)
        & short,
    )
