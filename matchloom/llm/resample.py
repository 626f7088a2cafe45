"""Importance resampling towards a target corpus.

Runs of words fall into buckets by their crc32. Each bucket's gain compares how often it occurs in the target and in the
documents; a document's weight is the mean gain of its runs, its score the weight and a Gumbel number of its id, so that
the highest scores are a draw without replacement in proportion to the weights. Scores are written once. The cutoff
is found by bisection: counts over the written scores, then over the ids tied at the cutoff. Only drawn rows are
sorted, by range, for their ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import encoded, pieces, slices, small_batches
from matchloom.session import materialise

BUCKETS, MAX_RUN, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Words whose bucket a worker remembers.
REMEMBERED = 500_000
#: Thresholds counted by one job: four halvings at once.
CUTS = 15

# A-Z become small letters; everything that is in no word becomes a blank
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Buckets(dict):
    """Bucket of a word or run, remembered up to a bound."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, run: bytes) -> int:
        bucket = crc32(run) % self.size
        if len(self) < REMEMBERED:
            self[run] = bucket
        return bucket


def run_buckets(text: str | None, buckets: Buckets, max_run: int) -> Iterator[tuple[int, np.ndarray]]:
    """Piece by piece: number of new words, and buckets of the runs that end in the piece."""
    before: list[bytes] = []
    for piece in pieces(encoded(text)):
        words = piece.translate(_WORDS).split()
        found = [np.fromiter(map(buckets.__getitem__, words), dtype=np.int32, count=len(words))]
        for n in range(2, max_run + 1):
            line = before[len(before) - min(n - 1, len(before)) :] + words
            runs = map(b" ".join, zip(*(islice(line, i, None) for i in range(n))))
            found.append(np.fromiter(map(buckets.__getitem__, runs), dtype=np.int32))
        before = (before + words)[-(max_run - 1) :] if max_run > 1 else before
        yield len(words), found[0] if max_run == 1 else np.concatenate(found)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """``bucket``, ``n``: how often each bucket occurs in all texts. A task sends one row per bucket at most."""

    def count(batches):
        known, total = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for part in slices(batches):
            for value in part.column(0).to_pylist():
                for _, found in run_buckets(value, known, max_run):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    rows = small_batches(texts).select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket; ``buckets`` rows come to the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for found, counts in ((s, corpus), (t, target)):
        for row in counts.collect():
            found[row.bucket] = row.n
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


_SCORED = "_id long, n_words long, n_features long, weight long"


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str, text: str, max_run: int = MAX_RUN) -> DataFrame:
    """``_id``, ``n_words``, ``n_features`` and ``weight``, the floored mean gain of a document's runs."""
    schema = pa.schema([(n, pa.int64()) for n in ("_id", "n_words", "n_features", "weight")])

    def score(batches):
        known = Buckets(len(gain))
        for part in slices(batches):
            words, sizes, means = [], [], []
            for value in part.column(1).to_pylist():
                n = m = total = 0
                for new, found in run_buckets(value, known, max_run):
                    n, m, total = n + new, m + len(found), total + int(gain[found].sum())
                words.append(n)
                sizes.append(m)
                means.append(total // m if m else 0)
            columns = [part.column(0), *(pa.array(c, pa.int64()) for c in (words, sizes, means))]
            yield pa.record_batch(columns, schema=schema)

    return small_batches(docs).select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(score, _SCORED)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a number u in (0, 1) that the id fixes; a null id counts as an empty one."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u))).cast("long")


def _least(rows: DataFrame, value: Column, enough: int) -> int:
    """The least value v of which ``rows`` have at least ``enough`` rows at or below v, by exact counts. Every job counts
    the rows below some thresholds that part the range evenly; a range of 64 bits takes 16 jobs."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        step = max(1, (high - low) // (CUTS + 1))
        cuts = [c for c in (low + step * i for i in range(CUTS)) if c < high]
        counts = rows.agg(*[F.count_if(value <= c).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        met = next((i for i, n in enumerate(counts) if n >= enough), None)
        if met is None:
            low = cuts[-1] + 1
        else:
            low, high = cuts[met - 1] + 1 if met else low, cuts[met]
    return low


def cutoff(scored: DataFrame, draw: int) -> tuple[int, int | None]:
    """The score and, among its rows, the id of the last row drawn. ``scored``: ``score``, ``_id``; ties to smaller ids,
    null ids last (then the id is None)."""
    score = -_least(scored, -F.col("score"), draw)
    left = draw - scored.where(F.col("score") > score).count()
    tied = scored.where((F.col("score") == score) & F.col("_id").isNotNull())
    return score, _least(tied, F.col("_id"), left) if tied.count() >= left else None


_RANKED = "_id long, n_features long, weight long, score long, _n long, _shard int, _before long"


def _running(batches):
    """Number of rows drawn before each line of a sorted range."""
    from pyspark import TaskContext

    shard, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = total + np.cumsum(batch.column(4).to_numpy())
        before = np.r_[total, ends[:-1]] if len(ends) else ends
        total = int(ends[-1]) if len(ends) else total
        columns = [*batch.columns, pa.array(np.full(len(ends), shard, dtype=np.int32)), pa.array(before.astype(np.int64))]
        names = [f.split()[0] for f in _RANKED.split(", ")]
        yield pa.record_batch(columns, names=names)


def _with_ranks(drawn: DataFrame, draw: int) -> DataFrame:
    """Global ranks: equal rows are one line with a number, lines are sorted by range, and the totals of the ranges are
    added up. Rows past ``draw`` (equal to the last one drawn) get null."""
    lines = drawn.groupBy("_id", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("_n"))
    order = [F.desc("score"), F.asc_nulls_last("_id")]
    sorted_lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    # written, for the ranges of a second computation could differ
    placed = materialise(sorted_lines.mapInArrow(_running, _RANKED), "ranks")
    totals = placed.groupBy("_shard").agg(F.sum("_n").alias("_total"))
    before = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = totals.select("_shard", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    rows = placed.join(F.broadcast(offsets), "_shard")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / 1024)))
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(1023).cast("long"), F.col("_n") - 1 - 1024 * F.col("_block"))))
    rows = rows.withColumn("_block", block).withColumn("_place", place)
    rank = F.col("_offset") + F.col("_before") + 1024 * F.col("_block") + F.col("_place") + 1
    return rows.select("_id", "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    max_run: int = MAX_RUN,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``min_words`` words, those most like ``target`` likeliest: ``doc_id``,
    ``n_features``, ``weight``, ``score`` and ``rank`` (from 1 by falling score, ties to the smaller id; null if not drawn)
    of every document.

    Words are runs of a-z, 0-9 and all characters outside ASCII, after A-Z became small letters; features are runs of 1
    to ``max_run`` words. Null and empty texts have no features and weight 0. A null id counts as an empty one in
    the draw and comes last among ties. Repeated rows are drawn apart. Without documents the result is empty, without
    a target all gains compare with nothing. Other columns are not read, whatever their names.
    """
    gain = gains(bucket_counts(docs, text, buckets, max_run), bucket_counts(target, target_text, buckets, max_run), buckets)
    scored = weights(docs, gain, doc_id, text, max_run).withColumn("score", F.col("weight") + gumbel(F.col("_id"), seed))
    scored = materialise(scored, "scores")
    eligible = scored.where(F.col("n_words") >= min_words)
    draw = math.floor(percent * eligible.count() / 100)
    rows = scored.select("_id", "n_features", "weight", "score")
    if not draw:
        return rows.withColumn("rank", F.lit(None).cast("long")).withColumnRenamed("_id", "doc_id")
    score, last = cutoff(eligible, draw)
    tied = F.col("score") == score
    if last is not None:
        tied = tied & F.coalesce(F.col("_id") <= last, F.lit(False))
    picked = (F.col("n_words") >= min_words) & ((F.col("score") > score) | tied)
    names = ["_id", "n_features", "weight", "score"]
    ranked = _with_ranks(scored.where(picked).select(*names), draw)
    rest = scored.where(~picked).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest).withColumnRenamed("_id", "doc_id")
