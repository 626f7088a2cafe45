"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are split into words at once, so that a very long text needs little memory.
PIECE_BYTES = 1 << 20
#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE_ROWS = 512
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 2000
#: The words of the text operators, as a pattern for Java and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
_LIBC = ctypes.CDLL(None)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encoded(text: str | None) -> bytes:
    """UTF-8 of a text; null gives nothing, a lone surrogate a replacement mark."""
    return b"" if text is None else text.encode("utf-8", "replace")


def pieces(data: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """Cut behind white space into pieces of about ``limit`` bytes; no word is cut."""
    at = 0
    while len(data) - at > limit:
        found = _SPACE.search(data, at + limit)
        end = found.end() if found else len(data)
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def give_back() -> None:
    """Return freed memory of this worker to the system: workers live on between stages, beside those that work."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def until_end(batches):
    """The batches of a task; at its end what they took is given back."""
    try:
        yield from batches
    finally:
        give_back()


def slices(batches, rows: int = SLICE_ROWS):
    """Arrow batches in parts of few rows."""
    for batch in until_end(batches):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small_batches(df: DataFrame) -> DataFrame:
    """Hand whole texts to Python in smaller Arrow batches than Spark's usual 10,000 rows, unless the session sets fewer."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name, "10000")) > BATCH_ROWS or int(conf.get(name, "10000")) <= 0:
        conf.set(name, str(BATCH_ROWS))
    return df


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, whatever else the input carries."""
    return df.select(*[F.col(c) for c in columns])
