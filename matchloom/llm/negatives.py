"""Hard negatives by the threshold algorithm.

Vectors are integers. Two searches use one scheme: candidates are dealt over blocks of bounded size; a block sorts its
candidates once per dimension and answers anchor after anchor. For an anchor it walks the sorted lists of all dimensions
together, each from the end its sign asks for (sorted access), scores every row met for the first time exactly (random
access), and stops once the threshold, the most that a row not yet met can score, is strictly below the kth score of
every window. The best rows of all blocks are then merged. Positives are the first search: one window without limits among
the anchor's own label. Each positive gives the second search a window of scores among all other labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import until_end
from matchloom.llm.search import finite_of
from matchloom.session import materialise

#: Candidates of a block.
BLOCK_ROWS = 16_384
POSITIVES, NEGATIVES, SCALE = 5, 3, 256
_MOST = (1 << 63) - 1
_EXACT = float(1 << 53)


class Block:
    """Candidates of one block, sorted in every dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(rows.T, self.order, axis=1)
        self.largest = np.abs(rows).max(initial=0.0)

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact integer products as longs: in doubles where these are exact, else in whole numbers of any size."""
        if self.largest * np.abs(q).sum() < _EXACT:
            return (self.rows[at] @ q).astype(np.int64)
        exact = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in self.rows[at]]
        if any(abs(s) > _MOST for s in exact):
            raise OverflowError("a score does not fit a long")
        return np.array(exact, dtype=np.int64)

    def _threshold(self, depth: int, q: np.ndarray, dims: np.ndarray, up: np.ndarray) -> float:
        """The most a row below the first ``depth`` of every list can score, rounded up."""
        n = len(self.ids)
        ends = [self.values[d, n - depth if u else depth - 1] for d, u in zip(dims, up)]
        total = float(np.dot(q[dims], ends))
        return total if abs(total) < _EXACT and self.largest * np.abs(q).sum() < _EXACT else total + abs(total) * 1e-9 + 1

    def search(self, anchor: int, q: np.ndarray, takes: np.ndarray, windows: list[tuple[int, int]], k: int):
        """The ``k`` best rows of every window of scores among the rows of ``takes``: (positions, scores) per window."""
        n = len(self.ids)
        unseen = takes & (self.ids != anchor)
        dims = np.flatnonzero(q)
        up = q[dims] > 0
        at, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        lowest = min(low for low, _ in windows)
        best: list = [(at, scores)] * len(windows)
        depth, step = 0, 64
        if not len(dims):
            at = np.flatnonzero(unseen)
            return [self._best(at, np.zeros(len(at), dtype=np.int64), w, k) for w in windows]
        while depth < n and unseen.any():
            to = min(n, depth + step)
            met = np.zeros(n, dtype=bool)
            for d, u in zip(dims, up):
                met[self.order[d, n - to : n - depth] if u else self.order[d, depth:to]] = True
            new = np.flatnonzero(met & unseen)
            unseen[new] = False
            found = self.scores(new, q)
            held = found >= lowest
            at, scores = np.concatenate([at, new[held]]), np.concatenate([scores, found[held]])
            best = [self._best(at, scores, w, k) for w in windows]
            bound = self._threshold(to, q, dims, up)
            if all(bound < low or (len(s) == k and bound < s[-1]) for (low, _), (_, s) in zip(windows, best)):
                break
            depth, step = to, 2 * step
        return best

    def _best(self, at, scores, window, k):
        inside = np.flatnonzero((scores >= window[0]) & (scores <= window[1]))
        if len(inside) > 8 * k:  # only what reaches the kth score is sorted
            kth = np.partition(scores[inside], len(inside) - k)[len(inside) - k]
            inside = inside[scores[inside] >= kth]
        top = inside[np.lexsort((self.ids[at[inside]], -scores[inside]))[:k]]
        return at[top], scores[top]


_FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _answers(other_label: bool, k: int):
    """Sorted rows of blocks: the candidates of a block first, which are held, then the anchors, which stream past."""
    schema = pa.schema([(f.split()[0], pa.int64()) for f in _FOUND.split(", ")])

    def run(batches):
        number, held, block = None, [], None
        for batch in until_end(batches):
            blocks, kinds, ids, labels = (batch.column(i).to_numpy() for i in range(4))
            change = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip(np.r_[0, change], np.r_[change, len(blocks)]):
                if a == b:
                    continue
                if blocks[a] != number:
                    number, held, block = blocks[a], [], None
                rows = _matrix(batch.column(4).slice(a, b - a))
                if kinds[a] == 0:
                    held.append((ids[a:b].copy(), labels[a:b].copy(), rows))
                    continue
                if not held:
                    continue
                if block is None:
                    block = Block(*(np.concatenate(x) for x in zip(*held)))
                out = []
                asked = batch.column(5).slice(a, b - a).to_pylist()
                for anchor, label, q, positives in zip(ids[a:b], labels[a:b], rows, asked):
                    takes = (block.labels != label) if other_label else (block.labels == label)
                    windows = [(p["low"], p["high"]) for p in positives]
                    for p, (at, scores) in zip(positives, block.search(anchor, q, takes, windows, k)):
                        out += [(anchor, p["id"], p["score"], i, s) for i, s in zip(block.ids[at], scores)]
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return run


_WINDOWS = "array<struct<id:bigint,score:bigint,low:bigint,high:bigint>>"


def _searched(candidates: DataFrame, anchors: DataFrame, other_label: bool, k: int) -> DataFrame:
    """Both with ``block``, ``vec_id``, ``label``, ``v``, the anchors with ``windows``: rank within (anchor, positive)."""
    none = F.lit(None).cast(_WINDOWS)
    names = ["block", "kind", "vec_id", "label", "v", "windows"]
    rows = candidates.withColumn("kind", F.lit(0)).withColumn("windows", none).select(*names)
    rows = rows.unionByName(anchors.withColumn("kind", F.lit(1)).withColumn("windows", F.col("windows").cast(_WINDOWS)).select(*names))
    found = rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_answers(other_label, k), _FOUND)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def prepared(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """``vec_id``, ``label``, ``v`` (floor(scale * x)) of the rows that take part, one per id."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and size(v) > 0").where(F.coalesce(finite_of("v"), F.lit(False)))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double")))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")
    rows = materialise(rows, "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def _hundredth(value: Column) -> Column:
    """value / 100, floored, in whole numbers."""
    return F.call_function("div", value - F.pmod(value, F.lit(100)), F.lit(100)).cast("long")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels
    whose score is between ``low_percent`` and ``high_percent`` of the positive's: ``anchor_id``, ``positive_id``, ``rank``
    (from 1), ``negative_id``, ``positive_score``, ``negative_score``. Exact; ties to the smaller id.

    ``is_anchor`` is a condition on ``vec_id`` and ``label``. Scores are integer inner products of floor(scale * x); one
    that does not fit a long is an error. Rows with a null id or label, a null or empty vector or a null or non-finite
    component take no part. An id is one row: of several rows the one of least label and vector takes part. Of vectors
    of several lengths those of the most frequent (then the longest) take part. Empty tables and anchors without
    positives or negatives give no rows. Other columns are not read, whatever their names.

    Every anchor meets every block of its label, then every block: work grows with anchors times rows, as asked.
    """
    base = prepared(vectors, vec_id, vector, label, scale)
    total = base.count()
    anchors = base.where(is_anchor)
    salt = lambda n: F.pmod(F.xxhash64("vec_id"), n)  # noqa: E731  (ids are distinct)
    # blocks of one label: several for a label of more rows than a block, of which there are total / block_rows at most
    large = base.groupBy("label").count().where(F.col("count") > block_rows)
    large = large.select("label", F.ceil(F.col("count") / block_rows).cast("long").alias("_n"))
    of_label = lambda df: df.join(F.broadcast(large), "label", "left").withColumn("_n", F.coalesce("_n", F.lit(1).cast("long")))
    place = F.xxhash64("label", "_salt")
    own = of_label(base).withColumn("_salt", salt(F.col("_n"))).withColumn("block", place)
    sent = of_label(anchors).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).withColumn("block", place)
    whole = F.struct(F.lit(-1).cast("long").alias("id"), F.lit(0).cast("long").alias("score"), F.lit(-_MOST).alias("low"), F.lit(_MOST).alias("high"))
    liked = _searched(own, sent.withColumn("windows", F.array(whole)), False, positives)
    # 100 * negative between the two percentages of the positive, in whole numbers
    low, high = -_hundredth(-F.lit(low_percent) * F.col("score")), _hundredth(F.lit(high_percent) * F.col("score"))
    window = F.struct(F.col("vec_id").alias("id"), "score", low.alias("low"), high.alias("high"))
    windows = liked.select("anchor_id", window.alias("w")).where("w.low <= w.high").groupBy("anchor_id").agg(F.collect_list("w").alias("windows"))
    windows = materialise(windows, "positives")  # at most ``positives`` of each anchor
    blocks = max(1, -(-total // block_rows))
    asked = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = _searched(base.withColumn("block", salt(F.lit(blocks))), asked, True, negatives)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
