"""A vector table that carries its own index for nearest neighbours.

    path/centres/        coarse centres, and how many buckets a search visits
    path/rows/           a keyed table (``snapshots``), partitioned by bucket

Centres are fitted on a bounded sample; every vector is stored in the bucket of its nearest centre. An upsert routes its
rows in the same way; where a key moves to another bucket it also leaves a mark in the old one, so that each bucket is
right by itself. A search visits the buckets nearest to each query, reads these partitions only, and scores exactly what
is in them (``matching.nearest`` within tenant and bucket, then the best over the buckets; where most buckets are visited,
within the tenant, with a mask of the buckets each query visits).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from matchloom import rules as R
from matchloom.operators import matching
from matchloom.session import materialise
from matchloom.sources import snapshots, tables

#: Bound of the sample that the centres are fitted on; a quarter of it only tests them.
SAMPLE_ROWS = 16_384
#: Rows a bucket is to hold, and the most buckets there are.
BUCKET_ROWS, MAX_BUCKETS = 20_000, 4096
RECALL = 0.95
#: A search that visits this share of the buckets or more meets whole tenants, and leaves out by a mask what it does not visit.
MASKED_SHARE = 0.25
KEYS = ("tenantId", "id", "bucket")
ORDER = ("version", "digest")


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def fit_centres(sample: np.ndarray, buckets: int, rounds: int = 15, seed: int = 11) -> np.ndarray:
    """Spherical k-means on unit vectors; an empty centre restarts at the vector that fits worst."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(buckets, len(sample)), replace=False)]
    for _ in range(rounds):
        scores = sample @ centres.T
        best = scores.argmax(1)
        worst = iter(np.argsort(scores.max(1), kind="stable"))
        sums = np.zeros_like(centres)
        np.add.at(sums, best, sample)
        for c in np.flatnonzero(np.bincount(best, minlength=len(centres)) == 0):
            sums[c] = sample[next(worst)]
        centres = _unit(sums)
    return centres


def probes_for(centres: np.ndarray, stored: np.ndarray, asked: np.ndarray, k: int, recall: float) -> int:
    """The least number of buckets that hold ``recall`` of the true neighbours of vectors the centres never saw."""
    if len(centres) == 1 or not len(asked) or not len(stored):
        return len(centres)
    own = (stored @ centres.T).argmax(1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    near = np.argsort(-(asked @ stored.T), axis=1, kind="stable")[:, :k]
    met = np.take_along_axis(place, own[near], axis=1)
    return next(p for p in range(1, len(centres) + 1) if (met < p).mean() >= recall)


def _routed(centres: np.ndarray, probes: int, vector: str) -> Column:
    @pandas_udf("array<int>")
    def route(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        rows = _unit(np.stack([np.asarray(x, dtype=np.float64) for x in v]))
        return pd.Series(list(np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return route(F.col(vector))


def _visits(centres: np.ndarray, probes: int):
    """Which buckets the queries look at, as a boolean matrix."""

    def visits(q: np.ndarray) -> np.ndarray:
        found = np.zeros((len(q), len(centres)), dtype=bool)
        near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
        np.put_along_axis(found, near, True, axis=1)
        return found

    return visits


def _centres(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    rows = spark.read.parquet(f"{path}/centres").orderBy("bucket").collect()  # MAX_BUCKETS rows at most
    return np.array([r.centre for r in rows]), rows[0].probes


def _stamped(df: DataFrame, centres: np.ndarray, vector: str, version: Column) -> DataFrame:
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256)
    stamped = df.withColumns({"version": version.cast("long"), "digest": digest, "deleted": F.lit(False)})
    return stamped.withColumn("bucket", F.element_at(_routed(centres, 1, vector), 1))


def create(
    vectors: DataFrame, path: str, vector: str = "embedding", version: int = 1, buckets: int | None = None,
    recall: float = RECALL, k: int = R.NEIGHBOURS, sample_rows: int = SAMPLE_ROWS,
) -> None:
    """Fit the centres on a sample of ``vectors`` (tenantId, id, ``vector`` and any other columns) and store all rows.

    Rows without a vector have no bucket and are left out; of rows with one key one is stored.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.size(vector) > 0)
    count = usable.count()
    share = min(1.0, 1.2 * sample_rows / max(count, 1))
    rank = F.pmod(F.xxhash64("tenantId", "id"), F.lit(1 << 40))
    some = usable.select(F.col(vector).cast("array<double>").alias("v"), rank.alias("r")).where(F.col("r") <= int(share * (1 << 40)))
    sample = np.array([r.v for r in some.orderBy("r").limit(sample_rows).collect()], dtype=np.float64)
    if not len(sample):
        raise ValueError("no vectors to fit an index on")
    sample = _unit(sample)
    wanted = buckets or min(MAX_BUCKETS, max(1, round(count / BUCKET_ROWS), int(np.sqrt(count) / 2)))
    seen, kept_out = (sample[: len(sample) * 3 // 4], sample[len(sample) * 3 // 4 :]) if len(sample) > 3 else (sample, sample[:0])
    centres = fit_centres(seen, min(wanted, len(seen)))
    probes = probes_for(centres, seen, kept_out, k, recall)
    rows = [(i, [float(x) for x in c], probes) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "bucket int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")
    stored = tables.latest(_stamped(usable, centres, vector, F.lit(version)), KEYS[:2], ORDER)
    # a bucket is a few files, sorted by tenant so that row groups can be skipped
    dealt = stored.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "tenantId")
    snapshots.create(dealt, f"{path}/rows", ["bucket"])


def upsert(vectors: DataFrame, path: str, version: int, vector: str = "embedding", name: str | None = None) -> None:
    """Insert or replace rows by (tenantId, id); a higher ``version`` wins, equal ones are told apart by their content."""
    centres, _ = _centres(vectors.sparkSession, path)
    rows = materialise(_stamped(vectors.where(F.size(vector) > 0), centres, vector, F.lit(version)), "routed")
    # only keys and buckets of the stored rows are read to see which keys move
    held = snapshots.read(vectors.sparkSession, f"{path}/rows", KEYS, ORDER, columns=["deleted"]).where("not deleted")
    same_key = (F.col("h.tenantId") == F.col("n.tenantId")) & (F.col("h.id") == F.col("n.id"))
    moved = held.alias("h").join(rows.alias("n"), same_key & (F.col("h.bucket") != F.col("n.bucket")))
    marks = moved.select("n.*", F.col("h.bucket").alias("_old")).withColumn("bucket", F.col("_old")).withColumn("deleted", F.lit(True)).drop("_old")
    snapshots.append(rows.unionByName(marks.withColumn(vector, F.lit(None).cast(rows.schema[vector].dataType))), f"{path}/rows", name, ["bucket"])


def compact(spark: SparkSession, path: str) -> bool:
    return snapshots.compact(spark, f"{path}/rows", KEYS, ORDER, ["bucket"])


def rows(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The stored vectors, of some buckets or all."""
    where = None if buckets is None else F.col("bucket").isin([int(b) for b in buckets])
    return snapshots.read(spark, f"{path}/rows", KEYS, ORDER, where).where("not deleted").drop("deleted", "digest")


def search(
    spark: SparkSession, path: str, queries: DataFrame, k: int = R.NEIGHBOURS, probes: int | None = None,
    query_id: str = "query_id", vector: str = "embedding",
) -> DataFrame:
    """About the ``k`` stored vectors of highest cosine similarity per query: (tenantId, query_id, doc_id, score, rank).

    ``probes`` defaults to the number that met the wished recall when the index was made; all buckets give the exact
    answer. A search stays inside the tenant of its query; queries without a vector find nothing.
    """
    centres, usual = _centres(spark, path)
    visited = min(probes or usual, len(centres))
    if visited == len(centres):  # every bucket for every query: no query is routed or copied
        held = rows(spark, path).select("tenantId", F.col("id").alias("doc_id"), vector)
        return matching.nearest(queries, held, k, ["tenantId"], query_id, "doc_id", vector)
    if visited >= MASKED_SHARE * len(centres):
        # a copy of a query per bucket, and its best of each bucket, would be far more rows than the vectors themselves
        held = rows(spark, path).select("tenantId", "bucket", F.col("id").alias("doc_id"), vector)
        return matching.nearest(queries, held, k, ["tenantId"], query_id, "doc_id", vector, part="bucket", visits=_visits(centres, visited))
    asked = queries.where(F.size(vector) > 0).select("tenantId", query_id, vector, _routed(centres, visited, vector).alias("bucket"))
    asked = materialise(asked.withColumn("bucket", F.explode("bucket")), "asked")
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # MAX_BUCKETS numbers at most
    held = rows(spark, path, buckets).select("tenantId", "bucket", F.col("id").alias("doc_id"), vector)
    found = matching.nearest(asked, held, k, ["tenantId", "bucket"], query_id, "doc_id", vector).drop("rank", "bucket")
    order = Window.partitionBy("tenantId", query_id).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
