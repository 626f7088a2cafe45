"""Exact and learned search by inner product, block by block.

Candidates are dealt over blocks of bounded size. A block's candidates and all queries sent to it are one sorted run of
rows: the candidates first, which are held, then the queries, which stream past them. So neither the table nor the
queries are ever held whole, and every block is one unit of parallel work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from matchloom.session import materialise

#: Candidates of a block.
BLOCK_ROWS = 8192
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_FOUND_DDL = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str, vector: str, zeros: bool) -> DataFrame:
    """``vec_id``, ``v`` (array<double>) of the rows that take part: an id, and finite components only; without
    ``zeros`` not all of them zero. Of vectors of several lengths those of the most frequent length (among equally
    frequent ones the longest) take part. That length costs a count over sizes, a few rows."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where("vec_id is not null and size(v) > 0").where(F.coalesce(finite_of("v"), F.lit(False)))
    if not zeros:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def finite_of(column: str):
    return F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _stream(kernel):
    """Run ``kernel(ids, matrix)`` for each block's candidates; it gives a function of (query ids, query matrix)."""

    def run(batches):
        block, held, search = None, [], None
        for batch in batches:
            blocks, kinds, ids = (batch.column(i).to_numpy() for i in range(3))
            change = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip(np.r_[0, change], np.r_[change, len(blocks)]):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, held, search = blocks[a], [], None
                rows = _matrix(batch.column(3).slice(a, b - a))
                if kinds[a] == 0:
                    held.append((ids[a:b].copy(), rows))
                    continue
                if not held:
                    continue
                if search is None:
                    search = kernel(*(np.concatenate(x) for x in zip(*held)))
                for at in range(0, b - a, 512):
                    found = search(ids[a + at : min(b, a + at + 512)], rows[at : at + 512])
                    if found:
                        yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found)], schema=_FOUND)

    return run


def _searched(candidates: DataFrame, queries: DataFrame, kernel, k: int) -> DataFrame:
    """Both with ``block``, ``vec_id``, ``v``: the best ``k`` of each query over the blocks it is sent to."""
    rows = candidates.select("block", F.lit(0).alias("kind"), "vec_id", "v").unionByName(
        queries.select("block", F.lit(1).alias("kind"), "vec_id", "v")
    )
    parted = rows.repartition("block").sortWithinPartitions("block", "kind")
    found = parted.mapInArrow(_stream(kernel), _FOUND_DDL)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _first_of(rows: DataFrame) -> DataFrame:
    """One vector per id: of an id's several vectors the least."""
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _threshold_kernel(k: int, first_step: int = 32):
    """Threshold algorithm: descend the sorted lists of all dimensions together, score what is met for the first time,
    and stop when what the frontier still allows is below the kth score."""

    def kernel(ids, matrix):
        order = np.argsort(matrix, axis=0, kind="stable").T.copy()
        values = np.take_along_axis(matrix.T, order, axis=1)
        n = len(ids)

        def one(query_id, q):
            dims = np.flatnonzero(q)
            seen = ids == query_id  # its own rows are no candidates
            if not len(dims):
                rest = np.flatnonzero(~seen)
                return rest[_best(ids[rest], np.zeros(len(rest)), k)], np.zeros(min(k, len(rest)))
            up = q[dims] > 0
            best, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
            depth, step = 0, first_step
            while depth < n:
                to = min(n, depth + step)
                met = [order[d, n - to : n - depth] if u else order[d, depth:to] for d, u in zip(dims, up)]
                new = np.unique(np.concatenate(met))
                new = new[~seen[new]]
                seen[new] = True
                best, scores = np.concatenate([best, new]), np.concatenate([scores, matrix[new] @ q])
                top = _best(ids[best], scores, k)
                best, scores = best[top], scores[top]
                bound = sum(q[d] * values[d, n - to if u else to - 1] for d, u in zip(dims, up))
                if len(best) == k and scores[-1] > bound:  # at equality a smaller id could still come
                    break
                depth, step = to, 2 * step
            return best, scores

        def search(query_ids, queries):
            out = []
            for query_id, q in zip(query_ids, queries):
                rows, scores = one(query_id, q)
                out.append((np.full(len(rows), query_id), ids[rows], scores))
            return out

        return search

    return kernel


def threshold_topk(
    vectors: DataFrame,
    queries: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    scale: int = 1024,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` best candidates of every query by the integer inner product of floor(scale * x): ``query_id``, ``rank``
    from 1, ``vec_id``, ``score`` (long), exact, ties to the smaller vec_id.

    ``queries`` and ``vectors`` share their columns. Rows with a null id, a null or empty vector or a null or non-finite
    component take no part, nor do vectors of another than the usual length. A query is no candidate of its own. Repeated
    candidate rows count apart; a repeated query is asked once. Scores are exact below 2^53. Empty tables give an
    empty result. Other columns are not read.
    """
    whole = lambda df: df.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double")))
    base = whole(usable(vectors, vec_id, vector, zeros=True))
    asked = _first_of(whole(usable(queries, vec_id, vector, zeros=True)))
    blocks = max(1, -(-base.count() // block_rows))
    # a hash of id and place in the input spreads repeated ids as well
    base = base.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)))
    sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = _searched(base, sent, _threshold_kernel(k), k)
    return found.withColumn("score", F.col("score").cast("long"))


# --- learned partitions


#: Bound of the sample that partitions and router are fitted on, and the partitions made of it.
SAMPLE_ROWS, PARTS, NEIGHBOURS = 8192, 16, 16


def neighbour_graph(rows: np.ndarray, k: int) -> np.ndarray:
    out = []
    for at in range(0, len(rows), 128):  # small, for it runs in the driver
        s = rows[at : at + 128] @ rows.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out.append(np.argpartition(-s, min(k, len(rows) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_partition(rows: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """Cut few edges of the graph with parts of nearly equal size: start from balanced centres, then move the nodes that
    gain most to the part of most of their neighbours as long as sizes allow."""
    n = len(rows)
    rng = np.random.default_rng(5)
    most, least = int(np.ceil(slack * n / parts)), int(n / parts / slack)
    centres = rows[rng.choice(n, parts, replace=False)]
    for _ in range(6):
        choice = np.argsort(-(rows @ centres.T), axis=1)
        part, room = np.full(n, -1), np.full(parts, most)
        for level in range(parts):
            for p in range(parts):
                want = np.flatnonzero((part < 0) & (choice[:, level] == p))
                want = want[np.argsort(-(rows[want] @ centres[p]), kind="stable")][: room[p]]
                part[want] = p
                room[p] -= len(want)
        centres = np.stack([rows[part == p].mean(0) if (part == p).any() else centres[p] for p in range(parts)])
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        links = np.zeros((n, parts))
        np.add.at(links, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(links, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        to = links.argmax(1)
        gain = links[np.arange(n), to] - links[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[to[i]] < most and size[part[i]] > least:
                size[part[i]] -= 1
                size[to[i]] += 1
                part[i] = to[i]
                moved += 1
        if not moved:
            break
    return part


def train_router(rows: np.ndarray, part: np.ndarray, parts: int, hidden: int = 64, steps: int = 800) -> tuple[np.ndarray, ...]:
    """Network of one hidden layer from a vector to the probabilities of the partitions."""
    rng, d = np.random.default_rng(6), rows.shape[1]
    w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden)]
    w += [rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, s = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(rows), min(512, len(rows)))
        x = rows[at]
        h = np.maximum(x @ w[0] + w[1], 0)
        p = _softmax(h @ w[2] + w[3])
        p[np.arange(len(at)), part[at]] -= 1
        p /= len(at)
        back = (p @ w[2].T) * (h > 0)
        for i, g in enumerate((x.T @ back, back.sum(0), h.T @ p, p.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.999 * s[i] + 0.001 * g * g
            w[i] = w[i] - 5e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Index:
    """Scale, router and number of probed partitions."""

    def __init__(self, scale, weights, parts, probes):
        self.scale, self.weights, self.parts, self.probes = scale, weights, parts, probes

    def route(self, rows: np.ndarray) -> np.ndarray:
        """Partitions by falling probability."""
        w = self.weights
        logits = np.maximum(rows / self.scale @ w[0] + w[1], 0) @ w[2] + w[3]
        return np.argsort(-logits, axis=1, kind="stable")


def fit_index(sample: np.ndarray, parts: int = PARTS, k: int = 20, recall: float = 0.97, probes: int | None = None) -> Index:
    """Fit on a sample. Without ``probes`` as many are taken as reach ``recall`` at the sample's own neighbours."""
    scale = np.sqrt((sample**2).mean()) * np.sqrt(sample.shape[1]) or 1.0
    rows = sample / scale
    parts = max(1, min(parts, len(rows) // 32))
    if parts == 1:
        return Index(scale, (np.zeros((rows.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1, 1)
    graph = neighbour_graph(rows, min(NEIGHBOURS, len(rows) - 1))
    part = balanced_partition(rows, graph, parts)
    index = Index(scale, train_router(rows, part, parts), parts, probes or parts)
    if probes is None:
        asked = np.arange(0, len(rows), max(1, len(rows) // 1024))
        routed = index.route(sample)
        own, near = routed[:, 0], neighbour_graph(rows, min(k, len(rows) - 1))[asked]
        place = np.argsort(routed[asked], axis=1)  # place of each partition in the query's order
        at = np.take_along_axis(place, own[near], axis=1)
        index.probes = next(p for p in range(1, parts + 1) if (at < p).mean() >= recall)
    return index


def _product_kernel(k: int):
    def kernel(ids, matrix):
        def search(query_ids, queries):
            out = []
            rough = queries @ matrix.T
            for query_id, q, scores in zip(query_ids, queries, rough):
                rows = np.flatnonzero(ids != query_id)
                if len(rows) > k:  # all that rounding could lift to the kth place
                    kth = np.partition(scores[rows], len(rows) - k)[len(rows) - k]
                    rows = rows[scores[rows] >= kth - 1e-9 * max(1.0, abs(kth))]
                exact = (matrix[rows] * q).sum(axis=1)  # the same for equal vectors, wherever they stand
                top = _best(ids[rows], exact, k)
                out.append((np.full(len(top), query_id), ids[rows[top]], exact[top]))
            return out

        return search

    return kernel


def learned_search(
    vectors: DataFrame,
    queries: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    parts: int = PARTS,
    recall: float = 0.97,
    probes: int | None = None,
    sample_rows: int = SAMPLE_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Approximately the ``k`` candidates of largest inner product for every query: ``query_id``, ``rank`` from 1,
    ``vec_id``, ``score`` (double), ties to the smaller vec_id.

    The neighbour graph of a sample of ``sample_rows`` vectors is cut into balanced ``parts``; a classifier learns the
    part of a vector. Every vector is indexed under its most probable part; a query is sent to its ``probes`` most
    probable ones, reranked there on the original vectors in double precision. Without ``probes`` the number is the
    least that finds ``recall`` of the sample's neighbours. A query whose parts hold fewer than ``k`` candidates is sent to
    all others too, so that it gets fewer than ``k`` only if there are fewer. Rows that do not take part, repeated rows and empty tables
    are treated as in ``threshold_topk``; zero vectors take no part either.
    """
    base, asked = usable(vectors, vec_id, vector, zeros=False), _first_of(usable(queries, vec_id, vector, zeros=False))
    count = base.count()
    if not count:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, 1.2 * sample_rows / count)
    rank = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 40))
    some = base.withColumn("_rank", rank).where(F.col("_rank") <= int(share * (1 << 40))).orderBy("_rank").limit(sample_rows)
    index = fit_index(np.array([r[0] for r in some.select("v").collect()]), parts, k, recall, probes)

    @pandas_udf("array<int>")
    def route(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(index.route(np.stack(v.to_numpy())).astype(np.int32)))

    # blocks of a part: as many as its expected size needs, dealt by a hash
    split = max(1, -(-count // (index.parts * block_rows)))
    salt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(split))
    base = base.withColumn("block", (F.element_at(route("v"), 1) * F.lit(split) + salt).cast("long"))

    def searched(queries: DataFrame, first: int, parts: int) -> DataFrame:
        sent = queries.withColumn("part", F.explode(F.slice(route("v"), first + 1, parts)))
        sent = sent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))
        sent = sent.withColumn("block", (F.col("part") * F.lit(split) + F.col("salt")).cast("long"))
        return _searched(base, sent, _product_kernel(k), k)

    found = searched(asked, 0, index.probes)
    if index.probes == index.parts:
        return found
    found = materialise(found, "found")
    number = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    met = asked.join(number, F.col("vec_id") == F.col("query_id"), "left")
    short = materialise(met.where(F.coalesce("n", F.lit(0)) < min(k, count - 1)).select("vec_id", "v"), "short")
    if short.isEmpty():
        return found
    both = found.unionByName(searched(short, index.probes, index.parts))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
