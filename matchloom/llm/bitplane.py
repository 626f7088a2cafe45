"""Token ids as shuffled planes of bytes or bits.

Documents are dealt out in ranges of ascending doc_id; each range is a shard whose ids form one stream. The stream is cut
into blocks of a fixed number of ids, each block is transposed into planes (all first bytes, all second bytes, ...), and
each plane is compressed by zstandard. A row of the written table holds some whole documents: their ids and lengths, the
blocks' payload, and the chunk index (ids of each block, bytes of each plane). Spark's writer commits the files.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import slices, small_batches
from matchloom.session import shared_dir

BLOCK_IDS = 1 << 16
#: A row is closed when it holds so many ids; a longer document has a row of its own.
ROW_IDS = 1 << 20
#: Chunks of text whose ids are remembered by a worker, for each of two generations, and their longest.
REMEMBERED = 600_000
_CHUNK_CHARS = 256
#: Longer texts are encoded piece by piece, shorter ones some at a time.
_CUT_CHARS, _SHORT_CHARS = 1 << 20, 1 << 16
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """The tokenizer of the file, with a memory of chunks.

    The pre-tokenizer of byte-level files never looks across a blank between two visible characters, so a text can be
    cut there and equal chunks need encoding once. Other files, and texts with special tokens, are encoded whole.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        pre = spec.get("pre_tokenizer") or {}
        self.cuttable = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _together(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks encoded as one text: a token that begins with the blank's byte begins a chunk."""
        found = self.tokenizer.encode_batch_fast([" " + " ".join(chunks)], add_special_tokens=False)[0].ids
        ids = np.array(found, dtype="<u4")
        starts = [4 * int(i) for i in np.flatnonzero(self.begins[ids])]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])]

    def _learn(self, lists: list[list[str]]) -> None:
        """Remember the ids of chunks that each follow a blank, but of none with white space at an end and of no long one."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older, missing = self.known, self.older, []
        for c in set().union(*lists).difference(known):
            if c in older:
                known[c] = older[c]
            elif c and len(c) <= _CHUNK_CHARS and not c[0].isspace() and not c[-1].isspace():
                missing.append(c)
        for at in range(0, len(missing), 1024):
            some = missing[at : at + 1024]
            known.update(zip(some, self._together(some)))

    def _known(self, first: str, rest: list[str]) -> bytes | None:
        """Ids of remembered chunks; None if one of them is not, or if the first blank is not on its own."""
        try:
            return None if first[-1:].isspace() else b"".join(map(self.known.__getitem__, rest))
        except KeyError:
            return None

    def _part(self, text: str, follows: bool) -> bytes:
        first, *rest = text.split(" ")
        self._learn([rest])
        found = self._known(first, rest)
        if found is None:
            first, *rest = _BETWEEN.split(text)
            found = b"".join(self._whole([" " + c for c in rest])) if rest else b""
        return self._whole([" " + first if follows else first])[0] + found

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. What is new in short texts is encoded at once, and so are their beginnings."""
        short = [i for i, t in enumerate(texts) if t and len(t) <= _SHORT_CHARS and self.cuttable and not any(s in t for s in self.special)]
        split = [texts[i].split(" ") for i in short]
        firsts, rests = [c[0] for c in split], [c[1:] for c in split]
        self._learn(rests)
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, first, rest, head in zip(short, firsts, rests, self._whole(firsts) if firsts else []):
            found = self._known(first, rest)
            if found is not None:
                out[i] = np.frombuffer(head + found, dtype="<u4")
        return [self.encode(t) if ids is None else ids for t, ids in zip(texts, out)]

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not self.cuttable or any(s in text for s in self.special):
            return np.frombuffer(self._whole([text])[0], dtype="<u4")
        out, at = [], 0
        while True:
            cut = _BETWEEN.search(text, at + _CUT_CHARS) if len(text) - at > _CUT_CHARS else None
            out.append(self._part(text[at : cut.start()] if cut else text[at:], at > 0))
            if not cut:
                return np.frombuffer(b"".join(out), dtype="<u4")
            at = cut.end()


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One encoder per worker process and file."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def to_planes(ids: np.ndarray, plane: str = "byte") -> list[bytes]:
    """Planes of a block: 4 of bytes or 32 of bits, least significant first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(bits[:, k])).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def pack_blocks(ids: np.ndarray, plane: str = "byte", block_ids: int = BLOCK_IDS):
    """Chunk index and payload of a run of ids."""
    press, index, payload = zstandard.ZstdCompressor(level=3), [], []
    for at in range(0, len(ids), block_ids):
        block = ids[at : at + block_ids]
        packed = [press.compress(p) for p in to_planes(block, plane)]
        index.append({"n": len(block), "sizes": [len(p) for p in packed]})
        payload += packed
    return index, b"".join(payload)


def unpack_blocks(index: list[dict], payload: bytes) -> np.ndarray:
    opened, at, out = zstandard.ZstdDecompressor(), 0, []
    for block in index:
        planes = []
        for size in block["sizes"]:
            planes.append(opened.decompress(payload[at : at + size]))
            at += size
        out.append(from_planes(planes, block["n"]))
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")


_ROW = pa.schema(
    [("shard", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
    + [("lengths", pa.list_(pa.int64()))]
    + [("chunks", pa.list_(pa.struct([("n", pa.int32()), ("sizes", pa.list_(pa.int32()))]))), ("payload", pa.binary())]
)
ROW_DDL = (
    "shard int, start long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, "
    "chunks array<struct<n:int,sizes:array<int>>>, payload binary"
)


def _write_shard(definition: str, end_id: int, plane: str):
    def run(batches):
        from pyspark import TaskContext

        shard, tool, start = TaskContext.get().partitionId(), encoder(definition), 0
        end = np.array([end_id], dtype="<u4")
        docs, held, size = [], [], 0

        def row():
            ids = np.concatenate(held)
            index, payload = pack_blocks(ids, plane)
            cols = [[shard], [start], [len(ids)], [docs], [[len(h) for h in held]], [index], [payload]]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ROW)], schema=_ROW)

        for part in slices(batches):
            for doc, ids in zip(part.column(0).to_pylist(), tool.encode_all(part.column(1).to_pylist())):
                docs.append(doc)
                held.append(np.concatenate([ids, end]))
                size += len(held[-1])
                if size >= ROW_IDS:
                    yield row()
                    start += size
                    docs, held, size = [], [], 0
        if held:
            yield row()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, plane: str = "byte") -> None:
    """Write the ids of ``docs`` (doc_id, text) below ``path``; ``tokenizer`` is the path of a tokenizers file.

    Documents follow each other by ascending doc_id (null first, repeated ids by a hash of the text). Null texts are
    empty; every document ends with ``end_id``. No documents write an empty table. Other columns are not read.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = small_batches(docs).select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(_write_shard(definition, end_id, plane), ROW_DDL).write.parquet(path)


_READ = pa.schema(
    [("shard", pa.int32()), ("local", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
)


def _read_rows(with_ids: bool):
    def run(batches):
        for part in slices(batches, 1):
            shard, start, _, doc_ids, lengths, index, payload = (c.to_pylist()[0] for c in part.columns)
            ids = unpack_blocks(index, payload)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            raw = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
            if not with_ids:
                raw = [zlib.crc32(r).to_bytes(4, "big") for r in raw]
            cols = [[shard] * len(doc_ids), (starts + start).tolist(), doc_ids, lengths, raw]
            for at in range(0, len(doc_ids), 1024):
                yield pa.record_batch([pa.array(c[at : at + 1024], f.type) for c, f in zip(cols, _READ)], schema=_READ)

    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian 32-bit ids) of
    every document, or ``ids_crc32`` in the place of ``ids``. Only totals of shards meet in one task."""
    rows = spark.read.schema(ROW_DDL).parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    found = rows.mapInArrow(_read_rows(with_ids), "shard int, local long, doc_id long, n_tokens long, ids binary")
    found = found.join(offsets, F.col("shard") == F.col("_shard"))
    last = F.col("ids") if with_ids else F.conv(F.hex("ids"), 16, 10).cast("long").alias("ids_crc32")
    return found.select("doc_id", (F.col("_before") + F.col("local")).alias("start"), "n_tokens", last)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, plane: str = "byte") -> DataFrame:
    """Write the ids into the shared folder and read their place, number and checksum back."""
    path = shared_dir(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer, end_id, plane)
    return read_ids(docs.sparkSession, path, with_ids=False)
