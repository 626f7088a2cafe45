import random

import numpy as np
import pytest

from matchloom.operators import coverage, matching, retrieval


def texts_and_needles(seed=3):
    rnd = random.Random(seed)
    alphabet = "ab c"
    texts = [(f"k{i % 3}", i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))) for i in range(90)]
    needles = [(f"k{i % 3}", i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 5)))) for i in range(60)]
    return texts, needles


@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("pairs", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
def test_contained_equals_brute_force(spark, monkeypatch, grid, pairs, keyed):
    monkeypatch.setattr(matching, "TEXT_BLOCK_CHARS", 200)
    monkeypatch.setattr(matching, "NEEDLE_BLOCK_CHARS", 20)
    texts, needles = texts_and_needles()
    t = spark.createDataFrame(texts, "k string, text_id int, text string")
    n = spark.createDataFrame(needles, "k string, needle_id int, needle string")
    keys = ["k"] if keyed else []
    got = [tuple(r) for r in matching.contained(t, n, keys, pairs=pairs, force_index=grid).collect()]
    want = {
        ((tk,) if keyed else ()) + ((ti,) if pairs else ()) + (ni,)
        for tk, ti, body in texts
        for nk, ni, needle in needles
        if (tk == nk or not keyed) and needle in body
    }
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
def test_nearest_equals_brute_force(spark, monkeypatch, grid, keyed):
    monkeypatch.setattr(matching, "VECTOR_BLOCK_ROWS", 17)
    monkeypatch.setattr(matching, "QUERY_BLOCK_ROWS", 5)
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(120, 8)).astype("float32")
    vecs[10:20] = vecs[0]  # exact copies: ties go to the smaller id
    key = ["hot" if i % 3 else "cold" for i in range(120)]
    v = spark.createDataFrame([(key[i], i, vecs[i].tolist()) for i in range(120)], "tenantId string, doc_id int, embedding array<float>")
    q = spark.createDataFrame([(key[i], i, vecs[i].tolist()) for i in range(0, 120, 4)], "tenantId string, query_id int, embedding array<float>")
    keys = ["tenantId"] if keyed else []
    got = {(r.query_id, r["rank"]): r.doc_id for r in matching.nearest(q, v, 4, keys, force_grid=grid).collect()}
    unit = vecs.astype("float64")
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {}
    for i in range(0, 120, 4):
        cand = [j for j in range(120) if not keyed or key[j] == key[i]]
        cand.sort(key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))
        want.update({(i, r + 1): j for r, j in enumerate(cand[:4])})
    assert got == want


@pytest.mark.parametrize("grid", [False, True])
def test_unsupported_and_coverage_plans_agree(spark, grid):
    bullets = spark.createDataFrame([("j", 1, "Built X" + "y" * 100), ("j", 2, "Never seen"), ("k", 3, "Built X")], "job string, bullet_id int, text string")
    evidence = spark.createDataFrame([("j", 1, "we built x" + "y" * 73 + " indeed")], "job string, text_id int, text string")
    # whole bullets are looked for unless a limit is asked for
    left = coverage.unsupported(bullets, evidence, ["job"], force_index=grid)
    assert {r.bullet_id for r in left.collect()} == {1, 2, 3}
    left = coverage.unsupported(bullets, evidence, ["job"], chars=80, force_index=grid)
    assert {r.bullet_id for r in left.collect()} == {2, 3}
    items = bullets.withColumnRenamed("bullet_id", "item_id")
    rows = coverage.substring_coverage(items, evidence, ["job"], force_index=grid).collect()
    assert {(r.job, r.total, r.hits, r.score) for r in rows} == {("j", 2, 0, 0.0), ("k", 1, 0, 0.0)}


def test_dedup_and_top_keep_the_stable_order(spark):
    rows = [("t", "j", "a", 0.5, 1), ("t", "j", "b", 0.9, 2), ("t", "j", "a", 0.9, 3), ("t", "j", "c", 0.9, 4), ("t", "j", "b", 0.9, 5)]
    df = spark.createDataFrame(rows, "tenantId string, jobId string, text string, score double, arrival int")
    best = retrieval.dedup_best(df)
    top = retrieval.top_chunks(best, n=2).orderBy("chunk_no").collect()
    assert [(r.text, r.score, r.first_seen) for r in top] == [("a", 0.9, 1), ("b", 0.9, 2)]


def test_retrieve_context(spark):
    vectors = spark.createDataFrame(
        [("t", "d1", "Built ML pipeline", {"type": "validated"}, [1.0, 0.0]), ("t", "d2", "Other", {}, [0.0, 1.0]), ("u", "d3", "Foreign", {}, [1.0, 0.0])],
        "tenantId string, id string, text string, metadata map<string,string>, embedding array<float>",
    )
    queries = spark.createDataFrame([("t", "job", n, [1.0, 0.1]) for n in range(3)], "tenantId string, jobId string, query_no int, embedding array<float>")
    feedback = spark.createDataFrame(
        [("t", "job#1", None, None, None), ("t", "job10#1", "wrong job", 1.0, ["x"]), ("t", "job#2", "Note", 0.5, ["good"])],
        "tenantId string, feedbackId string, text string, score double, tags array<string>",
    )
    own = retrieval.retrieve_context(queries, vectors, feedback).orderBy("chunk_no").collect()
    assert [r.text for r in own] == ["Built ML pipeline", "Note", "Other", ""]
    assert own[0].metadata == {"type": "validated"} and own[1].tags == ["good"]
    both = retrieval.retrieve_context(queries, vectors, None, cross_tenant=True).collect()
    assert {r.text for r in both} == {"Built ML pipeline", "Foreign", "Other"}
    assert retrieval.scan_feedback(feedback, "t", "job").count() == 2


def test_both_plans_on_null_keys_and_large_ids(spark):
    big = 1152921504606846977
    texts = spark.createDataFrame([("a", 1, "x needle y"), (None, 2, "needle"), ("a", None, "needle")], "k string, text_id long, text string")
    needles = spark.createDataFrame([("a", big, "needle"), (None, 11, "needle"), ("a", None, "x")], "k string, needle_id long, needle string")
    for pairs, want in ((False, [("a", big)]), (True, [("a", 1, big)])):
        for grid in (False, True):
            got = matching.contained(texts, needles, ["k"], pairs=pairs, force_index=grid).collect()
            assert sorted(tuple(r) for r in got) == want


def test_grid_of_one_table_and_without_keys(spark):
    rows = [(t, i, [float(i % 7), float(i % 5), 1.0]) for i in range(60) for t in ("a", "b")]
    df = spark.createDataFrame(rows, "tenantId string, id long, embedding array<double>")
    for keys in (["tenantId"], []):
        found = []
        for grid in (False, True):
            queries = df.where("id < 9 and tenantId = 'a'").withColumnRenamed("id", "query_id")
            hits = matching.nearest(queries, df.withColumnRenamed("id", "doc_id"), 5, keys, force_grid=grid)
            plan = hits._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
            found.append(sorted(map(tuple, hits.collect())))
        assert found[0] == found[1]


def test_index_against_brute_force(spark):
    import random

    rnd = random.Random(12)
    alphabet = ["red", "reds", "blue", "b", "ü1", "42", "-", "--", ", ", ". ", " ", "\n", "𝒳y", "x"]
    say = lambda n: "".join(rnd.choice(alphabet) + rnd.choice(["", " "]) for _ in range(n))
    texts = [(rnd.choice("ab"), i, say(12)) for i in range(60)] + [("a", 100, ""), ("a", 101, "red"), ("a", 101, "blue red"), ("b", 102, "red " * 30_000)]
    needles = [(rnd.choice("ab"), i, say(rnd.randint(0, 4))) for i in range(150)]
    needles += [("a", 500 + i, t[3:9]) for i, (_, _, t) in enumerate(texts)] + [("a", 900, ""), ("c", 901, "red"), ("a", 902, "nowhere at all")]
    t = spark.createDataFrame(texts, "k string, text_id long, text string")
    n = spark.createDataFrame(needles, "k string, needle_id long, needle string")
    want = {(k, i, j) for k, i, body in texts for l, j, needle in needles if k == l and needle in body}
    got = matching.contained(t, n, ["k"], pairs=True, force_index=True)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert {tuple(r) for r in matching.contained(t, n, ["k"], force_index=True).collect()} == {(k, j) for k, _, j in want}
    assert {tuple(r) for r in matching.contained(t, n, force_index=True).collect()} == {(j,) for _, j, needle in needles if any(needle in x for _, _, x in texts)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_scores_are_made_for_some_queries_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(2_000, 8)), rng.normal(size=(20_000, 8))
    tracemalloc.start()
    got = list(matching._best_rows(range(len(q)), q, np.arange(len(v)), v, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 6_000 and peak < 60 << 20  # all scores at once are 320 MB
    for i in (0, 99, 100, 1_999):
        scores = np.round(v @ q[i], matching.SCORE_DIGITS)
        assert [d for n, d, _ in got[3 * i : 3 * i + 3]] == sorted(range(len(v)), key=lambda d: (-scores[d], d))[:3]


def test_needles_of_one_word_compare_no_text(spark):
    texts = [(1, "a blue-green sky"), (2, "bluebells, ÉTÉ"), (3, "green"), (4, "green"), (5, "b lue"), (6, "")]
    needles = [(1, "blue"), (2, "green"), (3, "été"), (4, "ÉTÉ"), (5, "e"), (6, "none")]
    t = spark.createDataFrame(texts, "text_id int, text string")
    n = spark.createDataFrame(needles, "needle_id int, needle string")

    def found(needles):
        return matching.contained(t, needles, pairs=True, force_index=True)

    more = n.union(spark.createDataFrame([(7, "blue-g"), (8, "a blue"), (9, "-")], n.schema))
    for some in (n, more, n.where("false"), more.where("needle_id > 6")):
        want = {(a, b) for a, x in texts for b, y in some.collect() if y in x}
        assert {tuple(r) for r in found(some).collect()} == want
    # no text is compared, nor moved to Python workers, where all needles are single words
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" not in plan(found(n)) and "FlatMapCoGroups" in plan(found(more))
