"""Joins that are not equi joins: text containment and nearest neighbours.

Neither a cross join nor a pair per row of a group is ever produced. Both
operators run one of two plans and only emit matches:

* the small side is proven small (its rows and bytes are counted first): it is
  broadcast and the large side is scanned where it lies, without a shuffle;
* otherwise needles and texts meet by an inverted index over words; queries and vectors are cut into blocks of
  bounded size per key and each pair of blocks is one group of a cogroup. The number of blocks follows the counted
  weight of the key, so a key with a third of all rows becomes many groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom import rules as R
from matchloom.functions.rows import explode_rows

BROADCAST_ROWS = 50_000
BROADCAST_CHARS = 16_000_000
NEEDLE_BLOCK_CHARS = 16_000_000
TEXT_BLOCK_CHARS = 32_000_000
QUERY_BLOCK_ROWS = 20_000
VECTOR_BLOCK_ROWS = 50_000
#: Queries that are broadcast, and scores that a task holds at once.
SHARED_QUERIES = 10_000
SCORE_CELLS = 2_000_000


def is_bounded(df: DataFrame, weight: Column, max_rows: int, max_weight: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows of total weight ``max_weight`` (one cheap aggregate)."""
    n, w = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    return n <= max_rows and w <= max_weight


def block_grid(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: str,
    right_id: str,
    left_weight: tuple[Column, int],
    right_weight: tuple[Column, int],
) -> tuple[DataFrame, DataFrame]:
    """Give both sides the block columns ``_lb`` and ``_rb``.

    Each left row lies in one left block and is repeated once per right block of its
    key, and the other way round; so every pair of rows with equal keys meets in exactly
    one group (keys, _lb, _rb) whose size is bounded by the two weights.
    """
    keys = list(keys)

    def blocks(df, weight, name):
        expr, limit = weight
        number = F.greatest(F.ceil(F.sum(expr) / F.lit(limit)).cast("int"), F.lit(1)).alias(name)
        return df.groupBy(*keys).agg(number) if keys else df.agg(F.coalesce(number, F.lit(1)).alias(name))

    n_left, n_right = blocks(left, left_weight, "_nl"), blocks(right, right_weight, "_nr")
    if keys:
        grid = n_left.join(n_right, keys)
    else:  # two numbers, so no join
        fixed = {"_nl": n_left.first()[0], "_nr": n_right.first()[0]}

    def spread(df, id_col, own, n_own, other, n_other):
        sized = df.join(grid, keys) if keys else df.withColumns({n: F.lit(v) for n, v in fixed.items()})
        dealt = sized.withColumn(own, F.pmod(F.xxhash64(id_col), F.col(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))
        )
        # new column identities: both sides may come from one table
        return dealt.select(*[F.col(c).alias(c) for c in dealt.columns if c not in ("_nl", "_nr")])

    return (
        spread(left, left_id, "_lb", "_nl", "_rb", "_nr"),
        spread(right, right_id, "_rb", "_nr", "_lb", "_nl"),
    )


# --- containment ----------------------------------------------------------

def _automaton(needles: Sequence[str]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for i, needle in enumerate(needles):
        auto.add_word(needle, i)
    if len(needles):
        auto.make_automaton()
    return auto


class _Scanner:
    """Finds which of a list of needles occur in a text, and whose needles they are.

    ``owners``: needle -> key -> ids of that needle under that key.
    """

    def __init__(self, owners: dict[str, dict[tuple, list]]):
        self.everywhere = owners.get("", {})
        self.needles = [n for n in owners if n != ""]
        self.owners = [owners[n] for n in self.needles]
        self.auto = _automaton(self.needles)

    def hits(self, text: str, key: tuple) -> Iterator:
        yield from self.everywhere.get(key, ())
        if self.needles:
            for i in {i for _, i in self.auto.iter(text)}:
                yield from self.owners[i].get(key, ())


def contained(
    texts: DataFrame,
    needles: DataFrame,
    keys: Sequence[str] = (),
    text_id: str = "text_id",
    text: str = "text",
    needle_id: str = "needle_id",
    needle: str = "needle",
    pairs: bool = False,
    force_index: bool = False,
) -> DataFrame:
    """Which needles occur, character for character, in which texts with equal keys.

    ``pairs=False`` gives distinct (keys, needle_id): the needles found at all.
    ``pairs=True`` gives distinct (keys, text_id, needle_id). An empty needle occurs in every text.
    Rows with a null key, needle or text take no part, nor do needles (for pairs also texts) with a null id.
    Lower-case both sides before the call where case must not matter. Few needles are broadcast and each text is scanned
    once for all of them. Beyond the bound (or with ``force_index``) an inverted index over the words of the texts
    brings each text together with the needles it may hold (``_by_rarest_word``).
    """
    keys = list(keys)
    # a null key equals none, a hit without an id says nothing; and ids stay whole numbers in pandas
    texts = texts.select(*keys, text_id, text).dropna(subset=[*keys, text, *([text_id] if pairs else [])])
    needles = needles.select(*keys, needle_id, needle).dropna().distinct()
    fields = [texts.schema[k] for k in keys]
    if pairs:
        fields.append(texts.schema[text_id])
    fields.append(needles.schema[needle_id])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    names = [f.name for f in fields]
    n_keys = len(keys)

    bounded = not force_index and is_bounded(needles, F.length(needle) + 1, BROADCAST_ROWS, BROADCAST_CHARS)
    if bounded:
        owners: dict[str, dict[tuple, list]] = {}
        for row in needles.collect():  # bounded by the check above
            owners.setdefault(row[needle], {}).setdefault(tuple(row[:n_keys]), []).append(row[needle_id])
        shared = texts.sparkSession.sparkContext.broadcast(owners)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scanner = _Scanner(shared.value)
            seen: set = set()
            for batch in batches:
                out = []
                key_cols = [batch[k].tolist() for k in keys]
                for pos, (tid, body) in enumerate(zip(batch[text_id], batch[text].tolist())):
                    key = tuple(c[pos] for c in key_cols)
                    for nid in scanner.hits(body, key):
                        if pairs:
                            out.append((*key, tid, nid))
                        elif (key, nid) not in seen:
                            seen.add((key, nid))
                            out.append((*key, nid))
                yield pd.DataFrame(out, columns=names)

        return texts.mapInPandas(scan, schema).distinct()

    plain = texts.select(*keys, F.col(text_id).alias("_tid"), F.col(text).alias("_text"))
    wanted = needles.select(*keys, F.col(needle_id).alias("_nid"), F.col(needle).alias("_needle"))
    found = _by_rarest_word(plain, wanted, keys)
    every = plain if pairs else plain.dropDuplicates(keys) if keys else plain.limit(1)
    found = found.unionByName(_in_every_text(every, wanted.where("_needle = ''"), keys))
    symbols = wanted.where((F.col("_needle") != "") & ~F.col("_needle").rlike(_WORD))
    if not symbols.isEmpty():  # else every text would move to be held against none
        found = found.unionByName(_by_blocks(plain, symbols, keys))
    columns = [*keys, *([F.col("_tid").alias(text_id)] if pairs else []), F.col("_nid").alias(needle_id)]
    return found.select(*columns).distinct()


#: A word of a text or needle, and what a needle may have cut off: its first and last word, if nothing stands around them.
_WORD = r"[\p{L}\p{N}]+"
_EDGES = rf"^{_WORD}|{_WORD}\z"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def _inner_words(needle: Column) -> Column:
    """Words with something else on both sides: a text that holds the needle has them as words of its own."""
    return _words(F.regexp_replace(needle, _EDGES, ""))


def _grams(word: str) -> Column:
    """All runs of one to three characters of a word."""
    chars = F.split(word, "")

    def runs(size: int) -> Column:
        return F.transform(chars, lambda _, i: F.array_join(F.slice(chars, i + 1, F.lit(size)), ""))

    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


def _by_rarest_word(texts: DataFrame, needles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _tid, _nid) by an inverted index: needles wait at a word, and texts look only at those of their words.

    A needle waits at the rarest of its words that have something else on both sides, for these are words of any text
    around it. One without such a word waits at all words of the texts that contain its longest word, which are found in
    the vocabulary by runs of characters; if that word is the whole needle, any text of such a word holds it, and
    nothing else is compared. A text's words move without the text; the text itself moves once, to be compared with the
    other needles it met, and not at all if there are none. Equal texts of a key are one.
    """
    known = F.sha2("_text", 256)
    words = texts.select(*keys, known.alias("_t"), F.explode(F.array_distinct(_words(F.col("_text")))).alias("_word"))
    vocabulary = words.groupBy("_word").agg(F.count(F.lit(1)).alias("_df"))
    needles = needles.where(F.col("_needle").rlike(_WORD))
    inner = explode_rows(needles, [*keys, "_nid", "_needle"], F.array_distinct(_inner_words(F.col("_needle"))), "_word")
    # a word that no text holds comes first: nothing can be found
    rarity = F.struct(F.coalesce("_df", F.lit(0).cast("long")).alias("df"), "_word")
    rarest = inner.join(vocabulary, "_word", "left").groupBy(*keys, "_nid", "_needle").agg(F.min(rarity).alias("_r"))
    waiting = rarest.where("_r.df > 0").select(*keys, "_nid", "_needle", F.col("_r._word").alias("_word"))
    longest = F.array_max(F.transform(_words(F.col("_needle")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    outer = needles.where(F.size(_inner_words(F.col("_needle"))) == 0).withColumn("_part", longest["w"])
    parts = outer.select("_part", F.substring("_part", 1, 3).alias("_gram")).distinct()
    grams = explode_rows(vocabulary, ["_word"], _grams("_word"), "_gram")
    holding = parts.join(grams, "_gram").where(F.contains("_word", "_part")).select("_part", "_word")
    at_words = outer.join(holding, "_part").select(*keys, "_nid", "_needle", "_word", "_part")
    single = F.col("_part") == F.col("_needle")
    sure = words.join(at_words.where(single), [*keys, "_word"]).select(*keys, "_t", "_nid").distinct()
    named = texts.select(*keys, known.alias("_t"), "_tid")
    held = sure
    if not needles.where((F.size(_inner_words(F.col("_needle"))) > 0) | (longest["w"] != F.col("_needle"))).isEmpty():
        waiting = waiting.unionByName(at_words.where(~single).drop("_part"))
        met = words.join(waiting, [*keys, "_word"]).select(*keys, "_t", "_nid", "_needle").distinct()
        each = texts.select(*keys, known.alias("_t"), "_text").dropDuplicates([*keys, "_t"])
        held = met.join(each, [*keys, "_t"]).where(F.contains("_text", "_needle")).select(*keys, "_t", "_nid")
        if not needles.where(longest["w"] == F.col("_needle")).isEmpty():
            held = held.unionByName(sure)
    return held.join(named, [*keys, "_t"]).select(*keys, "_tid", "_nid")


def _in_every_text(texts: DataFrame, needles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _tid, _nid) of empty needles."""
    at = [*keys, "_one"]
    found = texts.withColumn("_one", F.lit(1)).join(needles.withColumn("_one", F.lit(1)), at)
    return found.select(*keys, "_tid", "_nid")


def _by_blocks(texts: DataFrame, needles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _tid, _nid) of needles without any word, block by block."""
    lt, rt = block_grid(
        texts, needles, keys, "_tid", "_nid", (F.length("_text") + 1, TEXT_BLOCK_CHARS), (F.length("_needle") + 1, NEEDLE_BLOCK_CHARS)
    )
    schema = T.StructType([*[texts.schema[k] for k in keys], texts.schema["_tid"], needles.schema["_nid"]])

    def match(group_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        key = tuple(group_key[: len(keys)])
        owners: dict[str, dict[tuple, list]] = {}
        for nid, word in zip(right["_nid"].tolist(), right["_needle"].tolist()):
            owners.setdefault(word, {}).setdefault(key, []).append(nid)
        scanner = _Scanner(owners)
        found = {(*key, tid, nid) for tid, body in zip(left["_tid"].tolist(), left["_text"].tolist()) for nid in scanner.hits(body, key)}
        return pd.DataFrame(list(found), columns=schema.names)

    by = [*keys, "_lb", "_rb"]
    return lt.groupBy(*by).cogroup(rt.groupBy(*by)).applyInPandas(match, schema)


# --- nearest neighbours ---------------------------------------------------

def _matrix(column: pa.Array | pa.ChunkedArray | pd.Series) -> np.ndarray:
    m = np.asarray(list(column), dtype=np.float64)
    m = m.reshape(len(column), -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by id."""
    if len(scores) > k:
        worst = np.partition(scores, len(scores) - k)[len(scores) - k]
        cand = np.flatnonzero(scores >= worst)
    else:
        cand = np.arange(len(scores))
    order = np.lexsort((ids[cand], -scores[cand]))
    return cand[order[:k]]


SCORE_DIGITS = 12  # equal vectors tie whatever the shape of their block


def _best_of(q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, parts=None, visits=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the ``k`` best vectors of each query in turn; scores are made for some queries at a time.

    With ``parts`` (of the vectors) only those in parts that ``visits`` (a function of some queries) names count.
    """
    strip = max(1, SCORE_CELLS // max(len(v), 1))
    for at in range(0, len(q), strip):
        scores = q[at : at + strip] @ v.T
        np.round(scores, SCORE_DIGITS, out=scores)
        if parts is not None:
            scores[~visits(q[at : at + strip])[:, parts]] = -np.inf
        for row in scores:
            best = _top(row, ids, k)
            if parts is not None:
                best = best[row[best] > -np.inf]
            yield ids[best], row[best]


def _best_rows(query_ids, q: np.ndarray, doc_ids: np.ndarray, v: np.ndarray, k: int, parts=None, visits=None):
    for qid, (ids, scores) in zip(query_ids, _best_of(q, doc_ids, v, k, parts, visits)):
        for doc, score in zip(ids, scores):
            yield qid, doc, float(score)


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = R.NEIGHBOURS,
    keys: Sequence[str] = ("tenantId",),
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector: str = "embedding",
    force_grid: bool = False,
    part: str | None = None,
    visits: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """The ``k`` vectors of highest cosine similarity per query: (keys, query_id, doc_id, score, rank).

    Exact. Each task scores a block of vectors by matrix products for some queries at a time (``SCORE_CELLS``) and keeps
    ``k`` rows per query, so what is shuffled is tasks x queries x k rows, never a pair per vector.
    ``keys=()`` searches across tenants. Rank starts at 1; ties go to the smaller id.

    ``part``, an int column of ``vectors``, and ``visits``, from unit vectors of queries to a boolean matrix (queries x
    parts), leave out the vectors of parts that a query does not visit. No query is copied per part.
    """
    keys = list(keys)
    queries = queries.select(*keys, query_id, vector).where(F.size(vector) > 0).dropna(subset=[*keys, query_id])
    of_part = [part] if part else []
    vectors = vectors.select(*keys, doc_id, vector, *of_part).where(F.size(vector) > 0).dropna(subset=[*keys, doc_id, *of_part])
    schema = T.StructType(
        [T.StructField(n, vectors.schema[n].dataType) for n in keys]
        + [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(doc_id, vectors.schema[doc_id].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    names = schema.names
    n_keys = len(keys)

    if not force_grid and is_bounded(queries, F.size(vector) * 4, SHARED_QUERIES, BROADCAST_CHARS):
        by_key: dict[tuple, tuple[list, list]] = {}
        for row in queries.collect():  # bounded by the check above
            ids, vecs = by_key.setdefault(tuple(row[:n_keys]), ([], []))
            ids.append(row[query_id])
            vecs.append(row[vector])
        shared = vectors.sparkSession.sparkContext.broadcast(
            {key: (ids, _matrix(vecs)) for key, (ids, vecs) in by_key.items()}
        )

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                groups = batch.groupby(keys, sort=False, dropna=False) if keys else [((), batch)]
                for key, rows in groups:
                    key = key if isinstance(key, tuple) else (key,)
                    if key not in shared.value:
                        continue
                    qids, q = shared.value[key]
                    v, ids = _matrix(rows[vector]), rows[doc_id].to_numpy()
                    parts = rows[part].to_numpy() if part else None
                    for qid, (cand_ids, cand) in zip(qids, _best_of(q, ids, v, k, parts, visits)):
                        old = best.get((key, qid))
                        if old is not None:
                            cand_ids, cand = np.concatenate([old[0], cand_ids]), np.concatenate([old[1], cand])
                            at = _top(cand, cand_ids, k)
                            cand_ids, cand = cand_ids[at], cand[at]
                        best[(key, qid)] = (cand_ids, cand)
            found = [
                (*key, qid, d, float(s)) for (key, qid), (ids, sc) in best.items() for d, s in zip(ids, sc)
            ]
            yield pd.DataFrame(found, columns=names)

        hits = vectors.mapInPandas(scan, schema)
    else:
        left, right = block_grid(
            queries,
            vectors,
            keys,
            query_id,
            doc_id,
            (F.lit(1), QUERY_BLOCK_ROWS),
            (F.lit(1), VECTOR_BLOCK_ROWS),
        )

        def match(group_key: tuple, qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
            if not len(qs) or not len(vs):
                return pd.DataFrame([], columns=names)
            key = tuple(group_key[:n_keys])
            parts = vs[part].to_numpy() if part else None
            rows = _best_rows(qs[query_id].tolist(), _matrix(qs[vector]), vs[doc_id].to_numpy(), _matrix(vs[vector]), k, parts, visits)
            return pd.DataFrame([(*key, *r) for r in rows], columns=names)

        by = [*keys, "_lb", "_rb"]
        hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(match, schema)

    order = Window.partitionBy(*keys, query_id).orderBy(F.desc("score"), F.asc(doc_id))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
