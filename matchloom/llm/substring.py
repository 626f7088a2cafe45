"""Removal of repeated passages by seed and extend.

Seeds: every window of ``window`` words picks its least ``anchor``-word run (winnowing). Equal windows pick equal
anchors, so a repeat of at least ``window`` words always shares one. Only anchors that occur twice are followed.
Extend: around a shared anchor, both ways, the windows that hold it are compared between all places of the anchor
at once, by their hashes of 128 bits, made of cryptographic digests of the words. Overlapping equal windows join into maximal repeats. Places of an anchor are grouped,
never paired; an anchor with very many places is dealt out over salts, and each salt hands on one place per window,
which are then counted by window: no task holds all places of an anchor.
Repeats inside a document are found there: of its places, only those with a window that it has not shown before go to
other documents, so a line said over and over is compared once a document, not once a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from matchloom.llm.common import encoded, pieces, slices, small_batches, until_end
from matchloom.session import discard, materialise

#: Windows hashed at once within a document.
SEGMENT = 1 << 17
#: Places of an anchor that one group may hold.
PLACES = 20_000
#: Words whose digests a worker remembers.
REMEMBERED = 1 << 17
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SEED = {name: np.uint64(s) for name, s in (("anchor", 0x2545F4914F6CDD1D), ("window", 0xD1342543DE82EF95), ("check", 0xA0761D6478BD642F))}


class _Digests(dict):
    """Digests of 128 bits by word; nobody writes two words of one digest. Of long words nothing is kept."""

    def __missing__(self, word: bytes) -> bytes:
        found = blake2b(word, digest_size=16).digest()
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


def _word_hashes(text: str | None, digests: _Digests) -> np.ndarray:
    """Digests of the words of a text, two numbers (a column) each."""
    found = [b"".join(map(digests.__getitem__, words)) for words in map(bytes.split, pieces(encoded(text)))]
    return np.ascontiguousarray(np.frombuffer(b"".join(found), dtype=np.uint64).reshape(-1, 2).T)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FACTOR
    return x ^ (x >> np.uint64(29))


def _runs(words: np.ndarray, length: int, seed: np.uint64) -> np.ndarray:
    """Hash of every run of ``length`` words, put together from runs of powers of two."""
    power, size, out, done = _mix(words ^ seed), 1, None, 0
    count = len(words) - length + 1
    while True:
        if length & size:
            part = power[done : done + count]
            out = part if out is None else _mix(out) * _FACTOR + part
            done += size
        if 2 * size > length:
            return out
        power = _mix(power[:-size]) * _FACTOR + power[size:]
        size *= 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the value of every run of ``width`` that is least in its upper 32 bits, the leftmost of several."""
    low = np.uint64(0xFFFFFFFF)
    best, span = (values & ~low) | np.arange(len(values), dtype=np.uint64), 1
    while 2 * span <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    count = len(values) - width + 1
    return (np.minimum(best[:count], best[width - span : width - span + count]) & low).astype(np.int64)


def _segments(words: np.ndarray, window: int, anchor: int, hashed: bool):
    """For parts of a document: first window, first window of each place (and the end) within the part, anchor hash of
    each place, hash of each window (two numbers, a row each) if ``hashed`` or an anchor has several places."""
    for at in range(0, words.shape[1] - window + 1, SEGMENT):
        part, check = words[:, at : at + SEGMENT + window - 1]
        grams = _runs(part, anchor, _SEED["anchor"])
        place = _least(grams, window - anchor + 1)
        first = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1, len(place)]  # the chosen place never moves back
        chosen, windows = grams[place[first[:-1]]], None
        if hashed or len(np.unique(chosen)) < len(chosen):
            windows = np.stack([_runs(part, window, _SEED["window"]), _runs(check, window, _SEED["check"])], axis=1)
        yield at, first, chosen, windows


def _runs_of(chosen: np.ndarray, border: np.ndarray | bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of chosen windows that no border cuts."""
    begins = chosen & np.r_[True, border | ~chosen[:-1]]
    stops = chosen & np.r_[border | ~chosen[1:], True]
    return np.flatnonzero(begins), np.flatnonzero(stops)


def _own(first: np.ndarray, chosen: np.ndarray, windows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Which places hold a window that no earlier place has, and which windows the part has more than once."""
    _, group, counts = np.unique(chosen, return_inverse=True, return_counts=True)
    shared = counts[group] > 1
    if not shared.any():
        return np.ones(len(chosen), dtype=bool), np.zeros(first[-1], dtype=bool)
    at = np.flatnonzero(np.repeat(shared, np.diff(first)))  # equal windows choose equal anchors
    order = np.lexsort(windows[at].T)  # stable: the earliest of equal windows comes first
    found = windows[at[order]]
    same = (found[1:] == found[:-1]).all(axis=1)
    twice, new = np.zeros(first[-1], dtype=bool), np.ones(first[-1], dtype=bool)
    twice[at[order]] = np.r_[same, False] | np.r_[False, same]
    new[at[order]] = ~np.r_[False, same]
    return np.logical_or.reduceat(new, first[:-1]), twice


_ANCHORS = pa.schema(
    [("anchor", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]
)


def _anchors(window: int, anchor: int):
    """Anchors of each document with the number of places to compare; and, without an anchor, the runs of windows that
    the document itself repeats."""

    def run(batches):
        digests = _Digests()
        for part in slices(batches):
            found, own = [], []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = _word_hashes(text, digests)
                if words.shape[1] < window:
                    continue
                hashes = []
                for at, first, chosen, windows in _segments(words, window, anchor, False):
                    kept, twice = _own(first, chosen, windows)
                    hashes.append(chosen[kept])
                    begins, stops = _runs_of(twice)
                    own.append((np.full(len(begins), key), begins + at, stops + at + 1))
                values, counts = np.unique(np.concatenate(hashes), return_counts=True)
                found.append((values.view(np.int64), np.full(len(values), key), counts))
            for rows, names in ((found, ("anchor", "key", "n")), (own, ("key", "start", "stop"))):
                columns = dict(zip(names, map(np.concatenate, zip(*rows))))
                if columns and len(columns["key"]):
                    none = pa.nulls(len(columns["key"]))
                    arrays = [pa.array(columns[f.name].astype(f.type.to_pandas_dtype())) if f.name in columns else none.cast(f.type) for f in _ANCHORS]
                    yield pa.record_batch(arrays, schema=_ANCHORS)

    return run


_PLACES = pa.schema(
    [("anchor", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("key", pa.int64()), ("start", pa.int32())]
    + [("windows", pa.binary())]
)


def _places(window: int, anchor: int):
    """Hashes of the windows around the places of repeated anchors, a row per place; a place whose windows all stand
    at earlier places of its document is left out."""

    def run(batches):
        digests = _Digests()
        for part in slices(batches):
            cols = [[] for _ in _PLACES]
            lists = part.column(2)
            for key, text, hits in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), lists):
                wanted = np.asarray(hits.values.field("anchor")).view(np.uint64)
                totals = np.asarray(hits.values.field("total"))
                order = np.argsort(wanted)
                wanted, totals = wanted[order], totals[order]
                words = _word_hashes(text, digests)
                for at, first, chosen, windows in _segments(words, window, anchor, True):
                    k = np.minimum(np.searchsorted(wanted, chosen), len(wanted) - 1)
                    hit = np.flatnonzero((wanted[k] == chosen) & _own(first, chosen, windows)[0])
                    salts = np.maximum(1, -(-totals[k[hit]] // PLACES))
                    cols[0].append(chosen[hit].view(np.int64))
                    spread = (key ^ (first[hit] + at) * 0x9E3779B1) >> 7  # by document and place
                    cols[1].append((spread & 0x7FFFFFFF) % salts)
                    cols[2].append(salts)
                    cols[3].append(np.full(len(hit), key))
                    cols[4].append(first[hit] + at)
                    cols[5] += [windows[first[i] : first[i + 1]].tobytes() for i in hit]
            if cols[0]:
                arrays = [pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype())) for c, f in zip(cols[:5], _PLACES)]
                yield pa.record_batch([*arrays, pa.array(cols[5], pa.binary())], schema=_PLACES)

    return run


_MARKS = pa.schema(
    [("again", pa.bool_()), ("anchor", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())]
    + [("windows", pa.list_(pa.int64())), ("checks", pa.list_(pa.int64()))]
)


def _compare(batches):
    """Windows that occur at two places of a group: their runs, as marks of the document. A salted group also hands
    on (``again``) one place of every window it has. The groups that a batch ends are compared all at once."""
    held, last = [], None  # the group that may go on in the next batch
    for part in slices(batches, 4096):
        if not part.num_rows:
            continue
        anchor, salt = part.column(0).to_numpy(), part.column(1).to_numpy()
        edges = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
        cut = int(edges[-1]) if len(edges) else 0
        if cut or (anchor[0], salt[0]) != last:
            if cut:
                held.append(part.slice(0, cut))
            yield from _compare_groups(held)
            held = []
        held.append(part.slice(cut))
        last = anchor[-1], salt[-1]
    yield from _compare_groups(held)


def _compare_groups(parts: list[pa.RecordBatch]):
    if not parts:
        return
    places = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    anchor, salt, salts, key, start = (c.to_numpy() for c in places.columns[:5])
    packed = places.column(5)
    ends = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]
    hashes = np.frombuffer(packed.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(np.uint64).reshape(-1, 2)
    values, checks = np.ascontiguousarray(hashes.T)
    if not len(values):
        return
    at = (ends - ends[0]).astype(np.int64) // 16  # first window of each place
    place = np.repeat(np.arange(len(packed)), np.diff(at))
    new = (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])
    group = np.r_[0, np.cumsum(new)].astype(np.uint64)[place]

    def alike(order):
        return [x[order[1:]] == x[order[:-1]] for x in (group, values, checks)]

    mixed = values + group * _FACTOR  # sorted at once, whatever groups there are
    order = np.argsort(mixed)
    same = np.logical_and.reduce(alike(order))
    if ((mixed[order[1:]] == mixed[order[:-1]]) & ~same).any():  # equal in one number only
        order = np.lexsort((checks, values, group))
        same = np.logical_and.reduce(alike(order))
    twice, first = np.zeros((2, len(values)), dtype=bool)
    twice[order] = np.r_[same, False] | np.r_[False, same]
    first[order] = ~np.r_[False, same]
    border = place[1:] != place[:-1]

    def marks(again, begins, stops, *lists):
        row = place[begins]
        columns = [np.full(len(row), again), anchor[row], key[row]]
        columns += [(start[row] + x - at[row]).astype(np.int32) for x in (begins, stops + 1)]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _MARKS)]
        return pa.record_batch([*arrays, *(lists or [pa.nulls(len(row), f.type) for f in list(_MARKS)[5:]])], schema=_MARKS)

    begins, stops = _runs_of(twice, border)
    if len(begins):
        yield marks(False, begins, stops)
    first &= (salts > 1)[place]
    begins, stops = _runs_of(first, border)
    if len(begins):
        bounds = pa.array(np.r_[0, np.cumsum(stops - begins + 1)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x[first].view(np.int64))) for x in (values, checks)]
        yield marks(True, begins, stops, *lists)


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "long", "int32": "int", "bool": "boolean", "binary": "binary"}
    ddl = lambda t: f"array<{ddl(t.value_type)}>" if pa.types.is_list(t) else names[str(t)]
    return ", ".join(f"{f.name} {ddl(f.type)}" for f in schema)


def _compared(places: DataFrame) -> DataFrame:
    parted = places.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return parted.mapInArrow(_compare, _ddl(_MARKS))


def _n_words():
    @pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in until_end(batches):
            yield pd.Series([len(encoded(t).split()) for t in texts], dtype="int32")

    return count


def _across_salts(again: DataFrame) -> DataFrame:
    """Marks of the windows that more than one salt of an anchor handed on. A group is one window of one anchor and has
    a row per salt at most."""
    rows = again.select("anchor", "key", "start", F.posexplode(F.arrays_zip("windows", "checks")).alias("i", "window"))
    copies = F.count("*").over(Window.partitionBy("anchor", "window.windows", "window.checks"))
    start = F.col("start") + F.col("i")
    return rows.withColumn("copies", copies).where("copies > 1").select("key", start.alias("start"), (start + 1).alias("stop"))


def repeated_windows(texts: DataFrame, window: int = 35, anchor: int = 8) -> DataFrame:
    """``key``, ``marks``: for each key, the runs (``start``, ``stop``) of first words of windows that start elsewhere too.

    ``texts`` has ``key`` (long, never null) and ``text``; rows that share a key must share the text, and count apart.
    They are one text in all that follows: every window of it is repeated, which one mark says.
    """
    copied = materialise(texts.groupBy("key").count().where("count > 1").select("key"), "copied")
    copies = texts.join(copied, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    copies = materialise(copies.select("key", "text"), "copies")
    texts = texts.join(copied, "key", "left_anti").select("key", "text").unionByName(copies)
    seeds = materialise(texts.mapInArrow(_anchors(window, anchor), _ddl(_ANCHORS)), "anchors")
    repeated = seeds.where("anchor IS NOT NULL").groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1")
    hits = seeds.join(repeated, "anchor").groupBy("key").agg(F.collect_list(F.struct("anchor", "total")).alias("hits"))
    around = texts.join(hits, "key").select("key", "text", "hits").mapInArrow(_places(window, anchor), _ddl(_PLACES))
    own = seeds.where("anchor IS NULL").select(F.lit(False).alias("again"), "key", "start", "stop")
    marks = materialise(_compared(around).unionByName(own, allowMissingColumns=True), "marks")
    discard(seeds)
    found = marks.where("not again").select("key", "start", "stop").unionByName(_across_salts(marks.where("again")))
    whole = copies.select("key", F.lit(0).alias("start"), (_n_words()(F.col("text")) - window + 1).alias("stop"))
    found = found.join(copied, "key", "left_anti").unionByName(whole.where("stop > 0"))
    found = found.select("key", F.struct("start", "stop").alias("mark"))
    return found.groupBy("key").agg(F.collect_list("mark").alias("marks"))


def _cut(window: int):
    @pandas_udf("n_words long, n_removed long, kept string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, marks in until_end(batches):
            rows = []
            for text, found in zip(texts, marks):
                words = encoded(text).split()
                if found is None or not len(found):
                    rows.append((len(words), 0, b" ".join(words).decode()))
                    continue
                step = np.zeros(len(words) + 1, dtype=np.int64)
                spans = np.array([(m["start"], m["stop"] + window - 1) for m in found])
                np.add.at(step, spans[:, 0], 1)
                np.add.at(step, spans[:, 1], -1)
                keep = np.cumsum(step[:-1]) == 0
                kept = b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])
                rows.append((len(words), int(len(words) - keep.sum()), kept.decode()))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    return cut


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, anchor: int = 8
) -> DataFrame:
    """All columns of ``docs`` and ``n_words``, ``n_removed``, ``kept``: the words that are left, joined by a space.

    A word goes if it lies in a window of ``window`` words whose word sequence also starts anywhere else, in this
    document or another; repeated rows are such other places. Windows are judged on the input. Null, blank and short
    texts keep all their words; a null text gives none. Columns of ``docs`` with one of the new names are replaced.
    """
    docs = small_batches(docs).drop("n_words", "n_removed", "kept")
    # the input's columns travel in a struct, so that no name of theirs can meet one made here
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    row_key = F.xxhash64(F.col(f"`{doc_id}`"), F.sha2(F.col(f"`{text}`"), 256))  # no two texts are written to share it
    keyed = docs.select(row_key.alias("key"), F.col(f"`{text}`").alias("text"), whole.alias("row"))
    marks = repeated_windows(keyed.select("key", "text"), window, anchor)
    joined = keyed.drop("text").join(marks, "key", "left")
    cut = joined.withColumn("cut", _cut(window)(F.col("row").getField(text), F.col("marks")))
    return cut.select("row.*", "cut.*")
