"""Near duplicates by SimHash fingerprints, linked through segment bit counts.

A fingerprint of 64 bits is embedded as the bit counts of its 32 segments of two bits. The Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints. The 32 coordinates form 8 groups; two points at
Manhattan distance 4 or less agree in at least 4 of them, whichever these are. So each distinct fingerprint enters one
grid cell for every choice of 4 groups, points of one cell are compared by Manhattan distance, and the rest is
verified on the fingerprints. In a cell only a spanning forest of the links is kept: a group of n near copies yields
at most n - 1 links per cell, never all pairs, and no link between different groups is lost.

A cell of more than ``CELL`` fingerprints is divided before it is compared. Two fingerprints at 4 bits or fewer have 4
groups equal bit by bit and meet in the cell of these; of the 8 half groups left at least 4 are equal too. So in a large
cell each fingerprint enters one part for every choice of 4 half groups, named by its bits there and in the cell's own
groups. Only 16 bits differ within a part: it holds 65,536 fingerprints at most.

``similar_documents`` links by similarity of the texts instead, where dozens of bits may differ: its fingerprints have 256
bits, and its grids take coordinates of the same embedding at random, as many grids as the share of pairs that must meet asks for. There the
fingerprints only find families of candidates; within a family the sets of shingles themselves decide about each link.
What grids miss is found by prefixes of the sets: no link is left to chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from matchloom.llm.common import encoded, pieces, slices, small_batches, until_end
from matchloom.llm.graph import components
from matchloom.session import materialise

BITS = 64
GROUPS = 8
#: Fingerprints of a cell that are compared as one group; more are divided first.
CELL = 8_192
_LOW = 0x5555555555555555
_ALL = (1 << BITS) - 1


def _fingerprint(text: str | None, words_each: int, seed: int) -> int:
    counts, total, tail = np.zeros(BITS, dtype=np.int64), 0, []
    digest = xxhash.xxh64_digest
    for piece in pieces(encoded(text).lower()):  # of bytes, lower() changes A-Z alone
        words = tail + piece.split()
        if len(words) < words_each:
            tail = words
            continue
        joined = b" ".join(words)
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        ends = starts[words_each:]
        hashes = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends)])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(ends)
        tail = words[len(words) - words_each + 1 :]
    if not total:
        if not tail:
            return 0
        counts = np.unpackbits(np.frombuffer(digest(b" ".join(tail), seed), dtype=np.uint8)).astype(np.int64)
        total = 1
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big", signed=True)


def fingerprint(text: Column | str, shingle_words: int = 4, seed: int = 42) -> Column:
    """Fingerprint of a text as a long. Null, empty and blank texts have fingerprint zero; a text of fewer words than
    a shingle has its whole word sequence as the only shingle."""

    @pandas_udf("long")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in until_end(batches):
            yield pd.Series([_fingerprint(t, shingle_words, seed) for t in texts], dtype="int64")

    return compute(text)


def embedding(fp: Column) -> Column:
    """Bit counts of the segments of two bits, each in unary (00, 01, 11): the number of differing bits of two
    embeddings is their Manhattan distance."""
    low = F.lit(_LOW)
    shifted = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(shifted).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(low), 1))


def _signed(value: int) -> int:
    value &= _ALL
    return value - (1 << BITS) if value >> (BITS - 1) else value


def cells(point: Column, distance: int) -> Column:
    """Grid cells of a point: the coordinates of some groups, all others blotted out by a code (10) no count has."""
    width = BITS // GROUPS
    blank = 0xAAAAAAAAAAAAAAAA
    keys = []
    for chosen in combinations(range(GROUPS), GROUPS - distance):
        mask = sum(((1 << width) - 1) << (width * g) for g in chosen)
        keys.append(point.bitwiseAND(F.lit(_signed(mask))).bitwiseOR(F.lit(_signed(blank & ~mask))))
    return F.array(*keys)


def _points(fps: np.ndarray) -> np.ndarray:
    low, one = np.uint64(_LOW), np.uint64(1)
    return ((fps | (fps >> one)) & low) | ((fps & (fps >> one) & low) << one)


def _near(fps: np.ndarray, points: np.ndarray, fp: np.uint64, point: np.uint64, distance: int) -> np.ndarray:
    close = np.flatnonzero(np.bitwise_count(points ^ point) <= distance)
    return close[np.bitwise_count(fps[close] ^ fp) <= distance]


def _forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Components of the links among the fingerprints of a cell, each as a star around its least fingerprint."""
    rest, links = np.unique(fps), []
    points = _points(rest)
    while rest.size > 1:
        root, open_ = rest[0], [(rest[0], points[0])]
        rest, points = rest[1:], points[1:]
        while open_ and rest.size:
            fp, point = open_.pop()
            found = _near(rest, points, fp, point, distance)
            if found.size:
                links.append((np.full(found.size, root), rest[found]))
                open_.extend(zip(rest[found], points[found]))
                keep = np.ones(rest.size, dtype=bool)
                keep[found] = False
                rest, points = rest[keep], points[keep]
    return links


_LINKS = pa.schema([("cell", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _link_cells(distance: int, limit: float):
    """Links (``a``, ``b``) of each cell. The fingerprints of a cell of more than ``limit`` are handed on instead, in ``a``
    beside their ``cell``; no more than ``limit`` and one batch are held at a time."""

    def linked(links):
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*links))
        return pa.record_batch([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], schema=_LINKS)

    def handed_on(cell, fps):
        columns = [pa.array(np.full(len(fps), cell)), pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64())]
        return pa.record_batch(columns, schema=_LINKS)

    def run(batches):
        held_cell, held, large = None, [], False  # the cell that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy().view(np.uint64)
            bounds = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            starts, ends = np.r_[0, bounds], np.r_[bounds, len(cell)]
            links, first = [], 0
            if held_cell is not None and cell[0] == held_cell:
                held.append(fps[: ends[0]].copy())
                first = 1
            large = large or sum(map(len, held)) > limit
            if large and held:
                yield handed_on(held_cell, np.concatenate(held))
                held = []
            if first < len(starts):
                if sum(map(len, held)) > 1:
                    links += _forest(np.concatenate(held), distance)
                sizes = (ends - starts)[first:-1]
                twos = starts[first:-1][sizes == 2]
                a, b = fps[twos], fps[twos + 1]
                near = np.bitwise_count(_points(a) ^ _points(b)) <= distance
                near[near] = np.bitwise_count(a[near] ^ b[near]) <= distance
                links.append((a[near], b[near]))
                for k in np.flatnonzero(sizes > 2) + first:
                    if ends[k] - starts[k] > limit:
                        yield handed_on(cell[starts[k]], fps[starts[k] : ends[k]])
                    else:
                        links += _forest(fps[starts[k] : ends[k]], distance)
                held_cell, held, large = cell[-1], [fps[starts[-1] :].copy()], False
            if links:
                yield linked(links)
        if held and (large or sum(map(len, held)) > limit):
            yield handed_on(held_cell, np.concatenate(held))
        elif sum(map(len, held)) > 1 and (links := _forest(np.concatenate(held), distance)):
            yield linked(links)

    return run


def _divide(distance: int):
    """The parts of large cells: bits of the cell's own groups and of each choice of half of the half groups left."""
    schema = pa.schema([("cell", pa.int64()), ("fp", pa.int64())])
    half = BITS // GROUPS // 2

    def run(batches):
        for batch in batches:
            cell = np.ascontiguousarray(batch.column(0).to_numpy())
            fps = batch.column(1).to_numpy().view(np.uint64)
            blank = cell.view(np.uint8).reshape(len(cell), GROUPS) == 0xAA
            left = 2 * np.nonzero(blank)[1].reshape(len(cell), distance)
            left = np.concatenate([left, left + 1], axis=1).astype(np.uint64)
            masks = np.uint64((1 << half) - 1) << (np.uint64(half) * left)
            own = ~masks.sum(axis=1, dtype=np.uint64)
            for chosen in combinations(range(2 * distance), distance):
                mask = own | masks[:, list(chosen)].sum(axis=1, dtype=np.uint64)
                key = ((fps & mask) * np.uint64(0x9E3779B97F4A7C15)) ^ (mask * np.uint64(0xBF58476D1CE4E5B9))
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(fps.view(np.int64))], schema=schema)

    return run


def fingerprint_links(fps: DataFrame, fp: str = "fingerprint", distance: int = 4, cell: int = CELL) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints whose components are those of all pairs that differ in
    ``distance`` bits or fewer. Nulls are left out; equal fingerprints need no link. Cells of more than ``cell``
    fingerprints are divided; the result does not depend on it."""
    if not 0 <= distance < GROUPS:
        raise ValueError(f"distance must be below {GROUPS}")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # small rows that become many: dealt over all tasks, however few partitions the distinct ones would fill
    nodes = fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct().repartition(tasks)

    def linked(pairs, limit):
        parted = pairs.repartition("cell").sortWithinPartitions("cell")
        return parted.mapInArrow(_link_cells(distance, limit), "cell long, a long, b long")

    pairs = nodes.select(F.explode(cells(embedding(F.col("fp")), distance)).alias("cell"), "fp")
    found = materialise(linked(pairs, cell), "cell_links")
    large = found.where("b is null").select("cell", "a").repartition("a")
    parts = linked(large.mapInArrow(_divide(distance), "cell long, fp long"), float("inf"))
    return found.where("b is not null").unionByName(parts).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, shingle_words: int = 4, seed: int = 42
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (long), ``component_id``.

    ``component_id`` is the smallest doc_id that links of ``distance`` or fewer differing bits reach, directly or over
    others. Repeated rows are all returned. Documents without words share fingerprint zero. A null doc_id keeps its
    row and names no component. An empty table gives an empty result. Other columns are not read.
    """
    rows = small_batches(docs).select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle_words, seed).alias("fingerprint"))
    rows = materialise(rows, "fingerprints")
    classes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    linked = components(fingerprint_links(rows, "fingerprint", distance))
    classes = classes.join(linked, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component")
    )
    names = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classes.join(names, "component").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, distance: int = 4) -> DataFrame:
    """The columns of ``docs`` for one document of each near-duplicate group: the one with the smallest doc_id, among
    repeated doc_ids the one whose text hashes least. Documents with a null doc_id are groups of their own."""
    return _firsts(docs, near_duplicates(docs, distance=distance))


def _firsts(docs: DataFrame, found: DataFrame) -> DataFrame:
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    chosen = docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    # the join has dealt the rows out by doc_id already
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    first = chosen.withColumn("_kept", F.row_number().over(order)).where("_kept = 1").drop("_kept")
    return first.unionByName(docs.where("doc_id is null"))


#: Width of the fingerprints that estimate similarity, as 64-bit words.
WIDE = 4
#: Fingerprints of a cell that one group compares with each other or with as many others.
BLOCK = 8_000
#: Shingles of a family that one group compares with each other or with as many others.
SHINGLES = 1_000_000
#: Share of the pairs at the similarity asked for that must meet in a cell, and unrelated fingerprints a cell may hold.
RECALL, UNRELATED = 0.99, 1_000
#: Grids whose families are found first; the others only look for links between these families.
FIRST_GRIDS = 8
_WORDS = [f"f{i}" for i in range(WIDE)]
_MIX = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & _ALL) for i in range(WIDE)]


def _shingles(text: str | None, words_each: int, seed: int) -> np.ndarray:
    """Sorted hashes of the set of shingles; a text of fewer words has its word sequence as the only one."""
    found, tail, digest = [], [], xxhash.xxh64_intdigest
    for piece in pieces(encoded(text).lower()):
        words = tail + piece.split()
        if len(words) < words_each:
            tail = words
            continue
        joined = b" ".join(words)
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        ends = starts[words_each:]
        found.append(np.fromiter([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends)], np.uint64, len(ends)))
        tail = words[len(words) - words_each + 1 :]
    if not found:
        return np.array([digest(b" ".join(tail), seed)] if tail else [], dtype=np.uint64)
    return np.unique(np.concatenate(found))


def _wide(text: str | None, words_each: int, seed: int) -> list[int]:
    """Fingerprint of the set of shingles; bits set in exactly half of them are 0 and 1 by turns."""
    return _majority(_shingles(text, words_each, seed))


def _majority(hashes: np.ndarray) -> list[int]:
    if not len(hashes):
        return [0] * WIDE
    counts = np.zeros(BITS * WIDE, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        some = hashes[at : at + (1 << 14)]
        x = np.stack([some + m for m in _MIX], axis=1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
    ties = np.arange(len(counts)) % 2
    return np.packbits(2 * counts + ties > len(hashes)).view(np.int64).tolist()


def wide_fingerprint(text: Column | str, shingle_words: int = 5, seed: int = 42) -> Column:
    """As array<long>: fingerprint of 256 bits of the set of a text's shingles, zero for a text without words, and
    behind it a hash that names the set."""

    @pandas_udf("array<long>")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in until_end(batches):
            sets = (_shingles(t, shingle_words, seed) for t in texts)
            yield pd.Series([[*_majority(h), _name(h)] for h in sets], dtype=object)

    return compute(text)


def _name(hashes: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes()))


def _shingle_sets(shingle_words: int, seed: int):
    @pandas_udf("set long, n long, shingles binary")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in until_end(batches):
            sets = (_shingles(t, shingle_words, seed) for t in texts)
            yield pd.DataFrame([(_name(h), len(h), h.tobytes()) for h in sets], columns=["set", "n", "shingles"])

    return compute


def _angle(similarity: float) -> float:
    """Share of differing bits expected of two equally large sets of that Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_distance(similarity: float) -> int:
    """Differing bits up to which fingerprints count as similar: those expected, and one standard error."""
    p, bits = _angle(similarity), BITS * WIDE
    return int(bits * p + np.sqrt(bits * p * (1 - p)))


def candidate_distance(similarity: float) -> int:
    """Differing bits up to which fingerprints are candidates: those expected, and four standard errors."""
    p, bits = _angle(similarity), BITS * WIDE
    return int(bits * p + 4 * np.sqrt(bits * p * (1 - p)))


def grid_size(count: int, similarity: float) -> tuple[int, int]:
    """Bits a cell is to tell apart, by the number of fingerprints, and grids needed for ``RECALL`` at the similarity, over
    all numbers of differing bits that pairs of that similarity have."""
    told = max(14, int(np.ceil(np.log2(max(count, 1) / UNRELATED))))
    p, bits = _angle(similarity), BITS * WIDE
    if p < 1e-6:  # rounding of the angle of equal sets
        return told, 1
    differ = np.arange(bits)
    ways = np.array([lgamma(bits + 1) - lgamma(d + 1) - lgamma(bits - d + 1) for d in range(bits)])
    share = np.exp(ways + differ * np.log(p) + (bits - differ) * np.log1p(-p))
    # a segment of two bits has the same count if neither differs, or both do in opposite ways
    alike = (1 - differ / bits) ** 2 + (differ / bits) ** 2 / 2
    meet = np.log1p(-np.minimum(alike ** segments(told), 1 - 1e-12))
    grids = 1
    while (share * np.exp(grids * meet)).sum() > 1 - RECALL:
        grids += 1
    return told, grids


def segments(told: int) -> int:
    """Segments whose counts tell that many bits apart: a count of two random bits is 0, 1, 1 or 2."""
    return int(np.ceil(told / -np.log2(2 * 0.25**2 + 0.5**2)))


def _grids(told: int, grids: int) -> np.ndarray:
    """Masks of each grid over the words of an embedding: both bits of some segments."""
    rng = np.random.default_rng(5)
    masks = np.zeros((grids, WIDE), dtype=np.uint64)
    for grid in range(grids):
        for c in rng.choice(WIDE * BITS // 2, segments(told), replace=False).tolist():
            masks[grid, 2 * c // BITS] |= np.uint64(3 << (2 * c % BITS))
    return masks


def _wide_cells(told: int, grids: int, first: int = 0) -> Column:
    """Grid cells of a fingerprint: in each grid, from the ``first`` on, the bit counts of some segments of its embedding.
    One Python function for all grids: as expressions of Spark they fill the driver with plans and generated code."""
    masks = _grids(told, grids)[first:]

    @pandas_udf("array<long>")
    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for points in until_end(batches):
            words = [points[w].to_numpy(np.int64).view(np.uint64) for w in _WORDS]
            found = np.empty((len(points), len(masks)), dtype=np.uint64)
            for grid, chosen in enumerate(masks):
                key = np.full(len(points), first + grid, dtype=np.uint64)
                for w in np.flatnonzero(chosen).tolist():
                    key = (key ^ (words[w] & chosen[w])) * np.uint64(0x9E3779B97F4A7C15)
                    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(32)
                found[:, grid] = key
            yield pd.Series(list(found.view(np.int64)), dtype=object)

    return compute(F.col("_points"))


def _wide_forest(nodes: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Components of the links of a cell, compared in strips: each as a star around its least node, so that cells that
    hold the same family say the same links. Rows of one node are linked from the start; a cell of one node is done."""
    order = np.argsort(nodes, kind="stable")
    nodes, fps = nodes[order], fps[order]
    own = np.searchsorted(nodes, nodes)  # the first row of the node
    points, labels = _points(fps), own.copy()
    for at in range(0, len(nodes) - 1, 64):
        if not labels.any():
            break  # all are linked
        strip = slice(at, at + 64)
        apart = np.zeros((len(points[strip]), len(nodes) - at), dtype=np.uint16)
        for w in range(WIDE):
            apart += np.bitwise_count(points[strip, w, None] ^ points[None, at:, w])
        near = apart <= distance  # the Manhattan bound
        for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
            close = np.flatnonzero(near[i]) + at
            close = close[np.bitwise_count(fps[close] ^ fps[at + i]).sum(axis=1, dtype=np.int64) <= distance]
            groups = np.unique(labels[close])
            if len(groups) > 1:
                labels[np.isin(labels, groups)] = groups[0]
    others = np.flatnonzero((labels != own) & (own == np.arange(len(nodes))))
    return [(nodes[labels[others]], nodes[others])] if len(others) else []


def _link_wide(distance: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held_cell, held = None, []  # the cell that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = np.stack([batch.column(2 + w).to_numpy().view(np.uint64) for w in range(WIDE)], axis=1)
            bounds = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            links = []
            for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(cell)]):
                if cell[a] != held_cell:
                    links += close(held)
                    held_cell, held = cell[a], []
                held.append((nodes[a:b], fps[a:b]))
            if links:
                yield out(links)
        if links := close(held):
            yield out(links)

    def close(held):
        if sum(len(n) for n, _ in held) < 2:
            return []
        nodes, fps = held[0] if len(held) == 1 else map(np.concatenate, zip(*held))
        return _wide_forest(nodes, fps, distance)

    def out(links):
        return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*links)], schema=schema)

    return run


def similar_links(
    nodes: DataFrame, similarity: float = 0.8, sizes: tuple[int, int] | None = None, first: int = 0
) -> DataFrame:
    """Candidate links ``a``, ``b`` between the nodes of ``nodes`` (``node`` and the words ``f0`` to ``f3``) within
    ``candidate_distance(similarity)``: of each grid cell, its components as stars around their least nodes. The Manhattan
    distance of two-bit counts bounds the pairs before they are verified.

    Fingerprints are embedded as the bit counts of their segments of two bits, as in ``fingerprint_links``. Each grid takes
    some of these coordinates at random; a cell holds the fingerprints that agree in all of them. The number of grids
    follows from the share of pairs that must meet, unless ``sizes`` gives both; grids before ``first`` are left out. Rows
    of one node count as linked. A cell of more than ``BLOCK`` fingerprints is cut into blocks, and every two blocks are one group, so that no
    task holds the cell and none of its links is lost.
    """
    told, grids = sizes or grid_size(nodes.count(), similarity)
    points = F.struct(*[embedding(F.col(w)).alias(w) for w in _WORDS])
    # small rows that become many: dealt over all tasks, however few files hold them
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_WORDS)
    embedded = nodes.select("node", *_WORDS, F.explode(F.array(points)).alias("_points"))  # once per fingerprint
    dealt = embedded.select(F.explode(_wide_cells(told, grids, first)).alias("cell"), "node", *_WORDS)
    hot = dealt.groupBy("cell").count().where(F.col("count") > BLOCK)
    hot = materialise(hot.select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot_cells")
    dealt = dealt.join(hot, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(*_WORDS, "cell"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (o != own) | (F.col("blocks") == 1))
    dealt = dealt.select("cell", own.alias("own"), "blocks", F.explode(others).alias("other"), "node", *_WORDS)
    group = F.when(F.col("blocks") == 1, F.col("cell")).otherwise(
        F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    )
    parted = dealt.select(group.alias("cell"), "node", *_WORDS).repartition("cell").sortWithinPartitions("cell")
    return parted.mapInArrow(_link_wide(candidate_distance(similarity)), "a long, b long").distinct()


def similar_families(nodes: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``node``, ``component``: the components of ``similar_links`` over all grids, as ``graph.components`` gives them.

    The first grids connect most of a large family. Over the others a family is one node, so that a cell says nothing
    of links within it: n near copies give no more than ``FIRST_GRIDS`` times n links, not one per copy and grid.
    """
    told, grids = grid_size(nodes.count(), similarity)
    early = components(similar_links(nodes, similarity, (told, min(grids, FIRST_GRIDS))))
    if grids <= FIRST_GRIDS:
        return early
    family = F.coalesce("component", "node")
    placed = materialise(nodes.join(early, "node", "left").withColumn("family", family), "families")
    between = similar_links(placed.select(F.col("family").alias("node"), *_WORDS), similarity, (told, grids), FIRST_GRIDS)
    later = components(between).select(F.col("node").alias("family"), F.col("component").alias("later"))
    whole = placed.join(later, "family", "left").select("node", F.coalesce("later", "family").alias("component"))
    return whole.where("node <> component").distinct()


_VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _set_forest(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs whose sets have the Jaccard similarity; only pairs not yet connected are compared."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    nodes, sizes = nodes[order], sizes[order]
    distinct, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts, labels, links = np.r_[0, np.cumsum(sizes)], np.arange(len(nodes)), []
    mark = np.zeros(len(distinct), dtype=bool)
    for i in range(len(nodes) - 1):
        last = np.searchsorted(sizes, sizes[i] / similarity + 1, "right")
        others = np.flatnonzero(labels[i + 1 : last] != labels[i]) + i + 1
        if not len(others) or not sizes[i]:
            continue
        own = ids[starts[i] : starts[i + 1]]
        mark[own] = True
        for at in range(0, len(others), 4096):
            some = others[at : at + 4096]
            taken = np.concatenate([ids[starts[j] : starts[j + 1]] for j in some.tolist()])
            bounds = np.r_[0, np.cumsum(sizes[some])[:-1]]
            shared = np.add.reduceat(mark[taken], bounds, dtype=np.int64)
            near = some[shared / (sizes[some] + sizes[i] - shared) >= similarity]
            groups, first = np.unique(labels[near], return_index=True)
            fresh = groups != labels[i]
            links += [(int(nodes[i]), int(nodes[j])) for j in near[first[fresh]].tolist()]
            labels[np.isin(labels, groups[fresh])] = labels[i]
        mark[own] = False
    return links


def _verify(similarity: float):
    def close(held):
        if len(held) > 1:
            nodes = np.array([n for n, _ in held])
            links = _set_forest(nodes, [np.frombuffer(s, dtype=np.uint64) for _, s in held], similarity)
            if links:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links)], schema=_VERIFIED)

    def run(batches):
        held_group, held = None, []
        for part in slices(batches):
            for group, node, shingles in zip(*[c.to_pylist() for c in part.columns]):
                if group != held_group:
                    yield from close(held)
                    held_group, held = group, []
                held.append((node, shingles))
        yield from close(held)

    return run


def _verified_links(docs: DataFrame, nodes: DataFrame, families: DataFrame, similarity: float, shingles) -> DataFrame:
    """Links ``a``, ``b`` that connect the nodes of a family just as all its pairs of ``similarity`` do.

    ``docs`` has ``doc_id`` and ``text``, ``nodes`` ``node`` and ``set``, ``families`` the ``component`` of each ``node``
    but the least. Sets are made anew from the texts of these nodes. A family of more than ``SHINGLES`` is cut into
    blocks, and every two blocks are one group, so that no task holds the family and no pair is left out.
    """
    members = families.union(families.select(F.col("component").alias("node"), "component").distinct())
    wanted = nodes.select("node", "set").join(members, "node")
    found = docs.join(wanted, F.col("doc_id") == F.col("node"))
    found = found.withColumn("_s", shingles(F.col("text"))).where("set = _s.set")
    found = found.groupBy("node", "set").agg(
        F.first("component").alias("family"), F.first("_s.n").alias("n"), F.first("_s.shingles").alias("shingles")
    )
    found = materialise(found, "shingle_sets")
    blocks = found.groupBy("family").agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("blocks"))
    dealt = found.join(blocks, "family").withColumn("blocks", F.greatest("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("set", "family"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (o != own) | (F.col("blocks") == 1))
    dealt = dealt.select("family", own.alias("own"), F.explode(others).alias("other"), "node", "shingles")
    group = F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other"))
    parted = dealt.select(group.alias("group"), "node", "shingles").repartition("group").sortWithinPartitions("group")
    return parted.mapInArrow(_verify(similarity), "a long, b long").distinct()


def _counted(shingle_words: int, seed: int, bits: int):
    """How many shingles of the sets of some texts fall into each of ``2**bits`` buckets, a row per bucket and slice."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for part in slices(batches):
            hashes = [_shingles(t, shingle_words, seed) for t in part.column(0).to_pylist()]
            found, n = np.unique(np.concatenate(hashes) >> np.uint64(64 - bits), return_counts=True)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n)], schema=schema)

    return run


def _prefixes(similarity: float, shingle_words: int, seed: int, bits: int, hot: np.ndarray, ranks: np.ndarray):
    """The rarest shingles of each set, so many that two sets of that similarity share one: those of buckets that are not
    ``hot`` first, the others by the count of their bucket, equal ones by their hash. All sets follow one order."""
    schema = pa.schema([("shingle", pa.int64()), ("set", pa.int64()), ("n", pa.int64()), ("place", pa.int64())])

    def run(batches):
        for part in slices(batches):
            found = []
            for text in part.column(0).to_pylist():
                hashes = _shingles(text, shingle_words, seed)
                if not len(hashes):
                    continue
                bucket = (hashes >> np.uint64(64 - bits)).view(np.int64)
                at = np.minimum(np.searchsorted(hot, bucket), max(len(hot) - 1, 0))
                rank = np.where(hot[at] == bucket, ranks[at], 0) if len(hot) else np.zeros(len(hashes), np.int64)
                first = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1
                chosen = hashes[np.lexsort((hashes, rank))[:first]].view(np.int64)
                found.append((chosen, np.full(first, _name(hashes)), np.full(first, len(hashes)), np.arange(first)))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], schema=schema)

    return run


def _meeting(similarity: float):
    """Pairs of nodes of different components that share a shingle of their prefixes, and may be as similar by the sizes
    of their sets and the places of the shingle in them."""
    share = similarity / (1 + similarity)

    def close(held):
        if not held:
            return
        node, component, n, left = (np.concatenate(c) for c in zip(*held))
        for at in range(0, len(node) - 1 if (component != component[0]).any() else 0, 64):
            strip = slice(at, at + 64)
            apart = component[strip, None] != component[None, at:]
            alike = np.minimum(left[strip, None], left[None, at:]) >= share * (n[strip, None] + n[None, at:]) - 1e-6
            alike &= np.minimum(n[strip, None], n[None, at:]) >= similarity * np.maximum(n[strip, None], n[None, at:]) - 1e-6
            once = (node[strip, None] < node[None, at:]) | (np.arange(len(node) - at) >= 64)
            i, j = np.nonzero(apart & alike & once)
            if len(i):
                yield pa.record_batch([pa.array(node[at + i]), pa.array(node[at + j])], schema=_VERIFIED)

    def run(batches):
        held_shingle, held = None, []
        for batch in until_end(batches):
            if not batch.num_rows:
                continue
            shingle, *rest = (c.to_numpy() for c in batch.columns)
            bounds = np.flatnonzero(shingle[1:] != shingle[:-1]) + 1
            for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(shingle)]):
                if shingle[a] != held_shingle:
                    yield from close(held)
                    held_shingle, held = shingle[a], []
                held.append(tuple(c[a:b] for c in rest))
        yield from close(held)

    return run


def _missed_links(docs: DataFrame, nodes: DataFrame, named: DataFrame, similarity: float, shingle_words: int, seed: int) -> DataFrame:
    """Verified links ``a``, ``b`` between nodes that ``named`` (``node``, ``component``) holds apart: all there are.

    Two sets of that similarity share a shingle of their prefixes (``_prefixes``), whatever their fingerprints say. The
    order follows the counts of shingles in buckets, so that common passages come last; only the buckets of far more
    shingles than the others have reach the driver.
    """
    spark, texts = docs.sparkSession, docs.select("text")
    bits = 24
    counted = texts.mapInArrow(_counted(shingle_words, seed, bits), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "shingle_counts")
    limit = 4 * int(counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] >> bits) + 16
    crowded = counted.where(F.col("n") > limit).orderBy("bucket").toArrow()  # 2**bits / 4 rows at most
    hot, ranks = crowded.column("bucket").to_numpy(), crowded.column("n").to_numpy()
    shingles = texts.mapInArrow(_prefixes(similarity, shingle_words, seed, bits, hot, ranks), "shingle long, set long, n long, place long")
    placed = nodes.select("set", "node").join(named, "node", "left").select("set", "node", F.coalesce("component", "node").alias("component"))
    met = shingles.distinct().join(placed, "set").select("shingle", "node", "component", "n", (F.col("n") - F.col("place")).alias("left"))
    met = met.repartition("shingle").sortWithinPartitions("shingle")
    pairs = materialise(met.mapInArrow(_meeting(similarity), "a long, b long").distinct(), "met")
    return _verified_links(docs, nodes, components(pairs), similarity, _shingle_sets(shingle_words, seed))


def similar_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle_words: int = 5, seed: int = 42
) -> DataFrame:
    """``doc_id``, ``component_id`` (smallest doc_id reachable) for every document whose doc_id is not null.

    Documents link if the Jaccard similarity of their shingle sets is ``similarity`` or more. Fingerprints of 256 bits
    find most candidates (``candidate_distance``), prefixes of the sets all others; the sets decide. Equal sets always link; documents without words are
    one group. A repeated doc_id is one node. An empty table gives an empty result. Other columns are not read.
    """
    docs = small_batches(docs).where(F.col(doc_id).isNotNull())
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = docs.select("doc_id", wide_fingerprint(F.col("text"), shingle_words, seed).alias("f"))
    rows = rows.select("doc_id", *[F.col("f")[i].alias(w) for i, w in enumerate([*_WORDS, "set"])])
    rows = materialise(rows, "wide_fingerprints")
    nodes = materialise(rows.groupBy("set", *_WORDS).agg(F.min("doc_id").alias("node")), "nodes")
    rows = rows.select("doc_id", "set")
    families = similar_families(nodes, similarity)
    links = _verified_links(docs, nodes, families, similarity, _shingle_sets(shingle_words, seed))
    links = materialise(links.union(_repeated(rows, nodes)), "links")
    missed = materialise(_missed_links(docs, nodes, components(links), similarity, shingle_words, seed), "missed")
    named = components(links.union(missed))
    owners = rows.join(nodes, "set").select("doc_id", "node").distinct()
    found = owners.join(named, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    return found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def _repeated(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of doc_ids that occur with different shingle sets."""
    several = rows.distinct().groupBy("doc_id").count().where("count > 1").select("doc_id")
    return rows.join(several, "doc_id").join(nodes, "set").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def keep_similar(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5) -> DataFrame:
    """The columns of ``docs`` for one document of each group of similar documents (``similar_documents``): the one with
    the smallest doc_id, among repeated doc_ids the one whose text hashes least. Documents with a null doc_id are groups
    of their own."""
    return _firsts(docs, similar_documents(docs, similarity=similarity, shingle_words=shingle_words))
