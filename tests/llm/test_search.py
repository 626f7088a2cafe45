"""Search operators against brute force, and the pipeline against its operators."""

import random

import numpy as np
import pytest
import test_texts
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import graph, search
from matchloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, v int, block int"


def vectors(spark, n=400, d=8):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[50:60] = x[40]  # ties
    rows = [(i, x[i].tolist(), 0, 0, 0) for i in range(n)]
    odd = [(1000, None), (1001, []), (1002, [None] * d), (1003, [float("nan")] * d), (1004, [float("inf")] * d)]
    odd += [(1005, [0.0] * d), (1006, [1.0]), (None, x[0].tolist()), (1008, [0.0] * d)]
    rows += [(i, v, 0, 0, 0) for i, v in odd]
    return spark.createDataFrame(rows, SCHEMA), {i: np.array(v, dtype=np.float64) for i, v, *_ in rows if i is not None and v and len(v) == d and None not in v and np.isfinite(v).all()}


def brute(base, asked, k, change=lambda v: v):
    out = []
    for q in asked:
        scored = sorted((-float(change(base[q]) @ change(v)), i) for i, v in base.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [8192, 37])
def test_threshold(spark, block_rows):
    df, base = vectors(spark)
    asked = [i for i in base if i % 5 == 0]
    got = search.threshold_topk(df, df.where("vec_id % 5 = 0"), block_rows=block_rows).collect()
    assert sorted(tuple(r) for r in got) == brute(base, asked, 10, lambda v: np.floor(1024 * v))
    few = search.threshold_topk(df.where("vec_id < 4"), df.where("vec_id < 4")).collect()
    assert len(few) == 12
    assert search.threshold_topk(df.where("vec_id < 0"), df).count() == 0


def test_learned_partitions(spark):
    df, base = vectors(spark)
    base = {i: v for i, v in base.items() if v.any()}
    asked = [i for i in base if i % 5 == 0]
    every = search.learned_search(df, df.where("vec_id % 5 = 0"), parts=4, probes=4, block_rows=60).collect()
    want = brute(base, asked, 20)
    assert [(r[0], r[1], r[2]) for r in sorted(tuple(r) for r in every)] == [w[:3] for w in want]
    assert np.allclose([r[3] for r in sorted(tuple(r) for r in every)], [w[3] for w in want])
    some = search.learned_search(df, df.where("vec_id % 5 = 0"), parts=4)
    truth = {(w[0], w[2]) for w in want}
    assert len(truth & {(r.query_id, r.vec_id) for r in some.collect()}) >= 0.9 * len(truth)
    assert search.learned_search(df.where("vec_id < 0"), df).count() == 0
    assert search.learned_search(df.where("vec_id < 2"), df.where("vec_id < 2")).count() == 2


def test_every_query_gets_its_rows(spark):
    """A cluster of one repeated id holds no candidate for its own query; others have to be found elsewhere."""
    rng = np.random.default_rng(9)
    centres = 20 * np.eye(16)
    x = centres[np.arange(1600) % 16] + rng.normal(size=(1600, 16))
    rows = [(i, x[i].tolist(), 0, 0, 0) for i in range(1600) if i % 16 != 3] + [(3, x[3].tolist(), 0, 0, 0)] * 100
    df = spark.createDataFrame(rows, SCHEMA)
    got = search.learned_search(df, df.where("vec_id < 40"), probes=1).collect()
    number = {q: sum(r.query_id == q for r in got) for q in {r[0] for r in rows if r[0] < 40}}
    assert set(number.values()) == {20}
    mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 3)
    near = {i: float(np.float64(np.float32(x[3])) @ np.float64(np.float32(x[i]))) for i in {r[0] for r in rows} - {3}}
    assert [v for _, v in mine] == sorted(near, key=lambda i: -near[i])[:20]
    few = search.learned_search(df.where("vec_id < 15"), df.where("vec_id < 15")).collect()
    assert len({r.query_id for r in few}) == 15


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    base = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in rows}
    truth = {(w[0], w[2]) for w in brute(base, [i for i in base if i % 20 == 0], 20)}
    got = QUERIES["op2_ann"](spark, sf).collect()
    assert len(truth & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(truth)


def test_partition_is_balanced():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(1000, 4)) + 5 * np.eye(4)[rng.integers(0, 4, 1000)]
    links = search.neighbour_graph(rows, 8)
    part = search.balanced_partition(rows, links, 4)
    assert np.bincount(part).max() <= 263
    assert (part[links] == part[:, None]).mean() > 0.8


def test_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(40)] + [(7, None), (9, 9)]
    group = {x: x for e in edges if None not in e for x in e}
    for a, b in [e for e in edges if None not in e] * 40:
        group[a] = group[b] = min(group[a], group[b])
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert {n: got.get(n, n) for n in group} == group
    assert graph.components(df.where("a < 0")).count() == 0


def brute_similar(rows, similarity=0.8, n=5):
    """Smallest doc_id reachable over links of ``similarity`` between the sets of five-word shingles."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or ({b" ".join(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if rows[i][0] == rows[j][0] or not both or len(sets[i] & sets[j]) / both >= similarity:
                if both or sets[i] == sets[j]:
                    group = [group[j] if g == group[i] else g for g in group]
    return [min(d for (d, _), h in zip(rows, group) if h == g) for g in group]


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force on what the stage before kept, with null ids, repeated rows and empty tables."""
    known = [r for r in test_texts.corpus() if r[0] is not None]
    known += [(900, "write to die.55@mail4.example.com"), (901, "!!! ### $$$"), known[3], known[3]]
    rows = known + [(None, "lost row"), (None, known[6][1])]
    docs = test_texts.frame(spark, rows)
    spark.createDataFrame([(d, 1) for d, _ in rows[:-3]], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality classifier"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    one = stage["SimHash near-dedup"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    left = [(r.doc_id, r.text) for r in one.collect()]
    assert {d for d, _ in left if d is not None} == set(brute_similar(known))
    assert len(left) == len(set(brute_similar(known))) + 2  # null ids are groups of their own
    cut = stage["substring dedup"](spark, one, str(tmp_path))
    assert cut.columns == docs.columns
    texts, lost = dict(r for r in left if r[0] is not None), sorted(t for d, t in left if d is None)
    found = {r.doc_id: r for r in cut.collect() if r.doc_id is not None}
    for d, _, gone, text in test_texts.brute_repeats(left):
        if d is not None:
            assert found[d].text == (text if gone else texts[d])
            assert found[d].text is None or found[d].n_chars == len(found[d].text)
    assert cut.where("doc_id is null").count() == len(lost)
    masked = stage["PII"](spark, cut, str(tmp_path))
    assert masked.columns == docs.columns
    assert "die.55@" not in masked.where("doc_id = 900").first().text
    packed = stage["best-fit packing"](spark, masked, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} >= {d for d, t in texts.items() if t and t.split()}
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.where("doc_id < 0"), str(tmp_path)).count() == 0


def test_pipeline_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.select("doc_id").distinct().count() < docs.count()
