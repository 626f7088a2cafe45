"""Best-fit packing of documents into sequences, with conflicts.

Items are dealt over shards by a hash of their id and place in the input, so that repeated rows spread; each shard is packed by itself, longest item first. Its open bins stand in order
of their free room. From the first bin with enough room the search goes on to the next larger ones until a bin is found
that holds neither the source nor the duplicate cluster of the item; both are bitmaps of the bin. So the bin chosen is
the tightest compatible one. A shard has a bounded number of items, however skewed sources and clusters are.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import WORD

CAPACITY = 2048
SHARD_ITEMS = 4096


def pack_shard(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and position of each item; ``sources`` and ``clusters`` are small numbers, -1 for no conflict."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    free: list[tuple[int, int]] = []  # (free room, bin), in order
    bitmaps: list[tuple[int, int]] = []
    used: list[int] = []
    placed = [(0, 0)] * len(lengths)
    for i in order:
        source = 1 << sources[i] if sources[i] >= 0 else 0
        cluster = 1 << clusters[i] if clusters[i] >= 0 else 0
        at = bisect_left(free, (lengths[i], -1))
        while at < len(free):
            have = bitmaps[free[at][1]]
            if not (have[0] & source or have[1] & cluster):
                break
            at += 1
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = capacity, len(bitmaps)
            bitmaps.append((0, 0))
            used.append(0)
        bitmaps[b] = (bitmaps[b][0] | source, bitmaps[b][1] | cluster)
        placed[i] = (b, used[b])
        used[b] += 1
        if room > lengths[i]:
            insort(free, (room - lengths[i], b))
    return placed


def _codes(values: pd.Series) -> list[int]:
    return pd.factorize(values, use_na_sentinel=True)[0].tolist()


def _pack(capacity: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["_id", "offset", "_key"], kind="stable").reset_index(drop=True)
        lengths = shard["length"].tolist()
        placed = pack_shard(lengths, _codes(shard["_source"]), _codes(shard["_cluster"]), capacity)
        shard["bin"] = [b for b, _ in placed]
        shard["position"] = [p for _, p in placed]
        return shard[["_id", "_n", "offset", "length", "shard", "bin", "position"]]

    return run


def best_fit(
    items: DataFrame,
    item_id: str = "doc_id",
    length: str = "length",
    source: str | None = "source",
    cluster: str | None = "cluster",
    capacity: int = CAPACITY,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``n_words`` (length of the whole item), ``offset`` and ``length`` of the piece,
    ``bin`` (shard * 2^32 + bin of the shard) and ``position`` in the bin.

    Items longer than ``capacity`` are cut: full pieces fill a bin of their own, the rest is packed. No bin holds more
    than ``capacity`` or two items of one source or of one cluster. A null source or cluster conflicts with nothing. An
    item of length zero, null or less has one row with length 0 and a null bin. Repeated rows are items of their own. An
    empty table gives an empty result. Ties go to the smaller id, then to the older bin. Other columns are not read.
    """
    size = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0).cast("long"))
    none = F.lit(None).cast("string")
    rows = items.select(
        F.col(item_id).cast("long").alias("_id"),
        size.alias("_n"),
        (F.col(source).cast("string") if source else none).alias("_source"),
        (F.col(cluster).cast("string") if cluster else none).alias("_cluster"),
    )
    count = rows.count()  # one number
    shards = max(1, -(-count // shard_items))
    full = F.floor((F.col("_n") - 1) / F.lit(capacity)).cast("long")  # pieces before the last
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(full, F.lit(0)))).alias("_piece"))
    pieces = pieces.select(
        "_id", "_n", "_source", "_cluster",
        (F.col("_piece") * capacity).alias("offset"),
        F.least(F.col("_n") - F.col("_piece") * capacity, F.lit(capacity)).cast("long").alias("length"),
        F.xxhash64("_id", "_n", "_source", "_cluster").alias("_key"),
    ).withColumn("shard", F.pmod(F.xxhash64("_id", "offset", F.monotonically_increasing_id()), F.lit(shards)))
    schema = "_id long, _n long, offset long, length long, shard long, bin long, position int"
    packed = pieces.where("length > 0").groupBy("shard").applyInPandas(_pack(capacity), schema)
    packed = packed.select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_words"), "offset", "length",
        (F.col("shard") * F.lit(1 << 32) + F.col("bin")).alias("bin"), "position",
    )
    empty = rows.where("_n = 0").select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_words"), F.lit(0).cast("long").alias("offset"),
        F.lit(0).cast("long").alias("length"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("position"),
    )
    return packed.unionByName(empty)


def document_items(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``length`` in words, ``source`` and ``cluster``: documents of the same words, but for case, are one cluster."""
    words = F.regexp_count("text", F.lit(WORD))
    return docs.select("doc_id", words.cast("long").alias("length"), "source", F.md5(F.lower("text")).alias("cluster"))
