"""Exact duplicates of texts by two-pass Bloom filtering, in DataFrame functions only.

A table of slim rows (id and 256-bit hash of the normalised text) is written once. In the first pass every hash sets one
slot of a bit table, and slots that are set by two rows or more are kept as a filter. Rows that meet it go through a
second pass with other slots. What meets both filters is possibly repeated: only these rows are shuffled by their
hash and counted. All others are unique and pass straight through.

A filter is made of slot numbers counted with map-side combine (a hot text is one slot per task) and held as bitmaps of
4 KB. Its size is fixed by the number of rows before it is made: up to ``broadcast_bytes`` it is broadcast, beyond that rows
meet it in a shuffle by bitmap. Texts move in ``keep_one`` only.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.session import materialise

#: Slots of a filter for each row: a unique row meets both filters by chance in about 1.4 % of cases.
SLOTS_PER_ROW = 8
#: The largest filter that is broadcast (268 million rows).
BROADCAST_BYTES = 1 << 28
#: Groups above 1/4096 of all rows, of which there are 4,096 at most, are joined by broadcast.
HEAVY_SHARE, HEAVY_ROWS = 4096, 1000
_BITMAP = 1 << 15  # bits of Spark's bitmaps
_SALTS = 16


def normalised(text: Column) -> Column:
    """A-Z in small letters and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # without other letters lower() does just that, and faster
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def _slot(seed: int, slots: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("_hash")), F.lit(slots))


def _filter(rows: DataFrame, seed: int, slots: int) -> DataFrame:
    """``_bucket``, ``_bits``: the slots that two rows or more fall on, ``slots`` / 8 bytes at most."""
    shared = rows.groupBy(_slot(seed, slots).alias("slot")).count().where("count > 1")
    buckets = shared.groupBy(F.bitmap_bucket_number("slot").alias("_bucket"))
    return buckets.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))


def _probed(rows: DataFrame, found: DataFrame, seed: int, slots: int, broadcast: bool) -> DataFrame:
    """``rows`` with ``_maybe``: whether their slot is in the filter."""
    slot = _slot(seed, slots)
    keyed = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).withColumn("_at", F.bitmap_bit_position(slot))
    if broadcast:
        met = keyed.join(F.broadcast(found), "_bucket", "left")
    else:  # a hot text is dealt over salts by its ids
        salts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(_SALTS)]))
        keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(_SALTS)))
        met = keyed.join(found.withColumn("_salt", salts), ["_bucket", "_salt"], "left").drop("_salt")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    bit = F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1
    return met.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_bucket", "_at", "_bits")


class Filters:
    """Both filters over slim rows, and how rows are held against them."""

    def __init__(self, slim: DataFrame, broadcast_bytes: int, slots_per_row: int = SLOTS_PER_ROW):
        self.rows = slim.count()
        self.slots = _BITMAP * max(1, -(-self.rows * slots_per_row // _BITMAP))
        self.broadcast = self.slots // 8 <= broadcast_bytes
        self.first = materialise(_filter(slim, 1, self.slots), "bloom")
        left = _probed(slim, self.first, 1, self.slots, self.broadcast).where("_maybe")
        self.second = materialise(_filter(left, 2, self.slots), "bloom")

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The possibly repeated rows and the unique ones. ``rows`` hold ``_id`` and ``_hash``."""
        one = _probed(rows, self.first, 1, self.slots, self.broadcast).withColumnRenamed("_maybe", "_one")
        both = _probed(one, self.second, 2, self.slots, self.broadcast)
        maybe = F.col("_one") & F.col("_maybe")
        return both.where(maybe).drop("_one", "_maybe"), both.where(~maybe).drop("_one", "_maybe")


def _hashed(doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias("_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("_hash")]


def _grouped(maybe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number of rows by text and id, written once, and by text the largest id and the number of rows."""
    copies = materialise(maybe.groupBy("_hash", "_id").agg(F.count(F.lit(1)).alias("_n")), "copies")
    return copies, copies.groupBy("_hash").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def exact_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id`` (the largest id of its group), ``group_size``, ``kept`` and
    ``text_sha256`` of the normalised text.

    Texts are equal if they are after A-Z became small letters. A null text is empty, an empty one a text like any other.
    Null ids count as smallest; a group of null ids only has no keep_id. Of rows that repeat both id and text
    one is kept. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    slim = materialise(docs.select(*_hashed(doc_id, text)), "hashes")
    filters = Filters(slim, broadcast_bytes)
    maybe, unique = filters.split(slim)
    copies, groups = _grouped(maybe)
    heavy = groups.where(F.col("group_size") > max(heavy_rows, filters.rows // HEAVY_SHARE))
    rows = copies.join(F.broadcast(heavy), "_hash").unionByName(
        copies.join(F.broadcast(heavy.select("_hash")), "_hash", "left_anti").join(groups, "_hash")
    )
    # repeated rows are counted and written out again, in two steps to keep the arrays short
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / 1024)))
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(1023).cast("long"), F.col("_n") - 1 - 1024 * F.col("_block"))))
    rows = rows.withColumn("_block", block).withColumn("_place", place)
    stays = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_block") == 0) & (F.col("_place") == 0)
    repeated = rows.select("_id", "_hash", "keep_id", "group_size", stays.alias("kept"))
    alone = unique.select("_id", "_hash", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    digest = F.lower(F.hex("_hash")).alias("text_sha256")
    return repeated.unionByName(alone).select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", digest)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with one row of equal texts, that of the largest id; all columns as they are.

    Unique rows are not shuffled; possibly repeated ones meet their group by hash and id, so that a large group is
    spread. Nulls, empty texts and repeated rows as in ``exact_duplicates``; which of several rows equal in id and
    text stays is not defined.
    """
    slim = materialise(docs.select(*_hashed(doc_id, text)), "hashes")
    filters = Filters(slim, broadcast_bytes)
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *_hashed(doc_id, text))
    maybe, unique = filters.split(held)
    _, groups = _grouped(filters.split(slim)[0])
    keys = groups.select("_hash", F.col("keep_id").alias("_keep"))
    on = (F.col("m._hash") == F.col("k._hash")) & F.col("m._id").eqNullSafe(F.col("k._keep"))
    stay = maybe.alias("m").join(keys.alias("k"), on, "left_semi").dropDuplicates(["_hash", "_id"])
    return stay.select("_row").unionByName(unique.select("_row")).select("_row.*")
