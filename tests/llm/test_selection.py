"""Exact duplicates, importance resampling and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from matchloom.llm import exact, negatives, resample


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def key(row):
    return tuple((x is None, x) for x in row)


# --- exact duplicates

TEXTS = [None, "", "  ", "Ärger", "ärger", "A", "a", "ÄR", "Är", "Straße İ", "straße İ", "x" * 200_000, "X" * 200_000]
TEXTS += [f"t{i}" for i in range(300)] + ["HOT"] * 400 + ["hot"] * 300
DOCS = [(i, t, "x") for i, t in enumerate(TEXTS)]
DOCS += [(None, "hot", "n"), (None, "lost", "n"), (None, "Lost", "n"), *[(5, "a", "dup")] * 1500]


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[low(t)].append(d)
    out, seen = [], set()
    for d, t, _ in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = max(ids, default=None)
        stays = d == keep and (low(t), d) not in seen
        seen.add((low(t), d))
        out.append((d, keep, len(groups[low(t)]), stays, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize(("broadcast_bytes", "heavy_rows"), [(1 << 28, 1000), (0, 50)])
def test_exact(spark, broadcast_bytes, heavy_rows):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, keep_id string").repartition(5)
    got = exact.exact_duplicates(df, broadcast_bytes=broadcast_bytes, heavy_rows=heavy_rows)
    assert sorted((tuple(r) for r in got.collect()), key=key) == brute_exact(DOCS)
    one = exact.keep_one(df, broadcast_bytes=broadcast_bytes)
    assert one.columns == df.columns
    want = {(h, k) for _, k, _, _, h in brute_exact(DOCS)}
    left = [(hashlib.sha256(low(r.text).encode()).hexdigest(), r.doc_id) for r in one.collect()]
    assert len(left) == len(set(left)) and set(left) == want
    assert exact.exact_duplicates(df.where("doc_id < 0")).count() == 0
    assert exact.keep_one(df.where("doc_id < 0")).count() == 0


def test_filters_find_every_repeated_row_and_few_others(spark):
    rows = [(i, f"text {i % 9000}") for i in range(10_000)]
    slim = spark.createDataFrame(rows, "doc_id long, text string").select(*exact._hashed("doc_id", "text"))
    maybe, unique = exact.Filters(slim, 1 << 28).split(slim)
    found = {r[0] for r in maybe.collect()}
    repeated = {i for i in range(10_000) if i % 9000 < 1000}
    assert repeated <= found and len(found - repeated) < 0.05 * 8000
    assert unique.count() + len(found) == 10_000
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Python" not in plan  # unique rows are not shuffled


# --- importance resampling


def brute_resample(docs, target, max_run, min_words, percent, buckets=10_000, seed=2024):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        runs = [" ".join(words[i : i + n]) for n in range(1, max_run + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    own = [(d, *features(t)) for d, t, *_ in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in s}
    out = []
    for d, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((n, d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    can = sorted((r for r in out if r[0] >= min_words), key=lambda r: (-r[4], r[1] is None, r[1]))
    drawn = can[: percent * len(can) // 100]
    rest = list(out)
    for r in drawn:
        rest.remove(r)
    rows = [(*r[1:], i + 1) for i, r in enumerate(drawn)] + [(*r[1:], None) for r in rest]
    return sorted(rows, key=key)


def resample_docs():
    rnd = random.Random(4)
    say = lambda n: " ".join(rnd.choice(["Alpha", "beta", "GAMMA", "é-x", "día", "42", "zeta"]) for _ in range(n))
    rows = [(i, say(rnd.randint(1, 60)), "w") for i in range(300)] + [(400, None, "w"), (401, "", "w"), (402, "... --- ...", "w")]
    rows += [(500 + i, "same words " * 20, "w") for i in range(40)] + [(700, "same words " * 20, "w")] * 40
    return rows + [(None, say(50), "w"), (None, say(50), "w"), (800, "Long-Word " * 150_000, "w")], [say(40) for _ in range(5)] + [None, ""]


@pytest.mark.parametrize(("max_run", "percent"), [(1, 10), (1, 100), (2, 37), (3, 99)])
def test_resample(spark, max_run, percent):
    docs, target = resample_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resample.resample(df, aim, max_run=max_run, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=key) == brute_resample(docs, target, max_run, 20, percent)


def test_resample_of_nothing(spark):
    docs, target = resample_docs()
    df = spark.createDataFrame(docs[:50], "doc_id long, text string, score string")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert resample.resample(df.where("doc_id < 0"), aim).count() == 0
    got = resample.resample(df, aim.where("false"))
    assert sorted((tuple(r) for r in got.collect()), key=key) == brute_resample(docs[:50], [], 1, 20, 10)
    assert resample.resample(df, aim, min_words=10**6).where("rank is not null").count() == 0


def test_cutoff_is_exact(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(-(10**12), 10**12), rnd.randint(0, 3)) for _ in range(400)] + [(7, 2)] * 30 + [(None, 2)] * 5
    df = spark.createDataFrame(rows, "_id long, score long")
    ordered = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0]))
    for draw in (1, 2, 77, 200, 300, 434, 435):
        score, last = resample.cutoff(df, draw)
        assert (last, score) == ordered[draw - 1]


def test_words_of_a_long_text_cross_pieces(monkeypatch):
    text = "Alpha beta, GAMMA delta-x " * 40
    whole = [b for _, f in resample.run_buckets(text, resample.Buckets(10_000), 3) for b in f]
    monkeypatch.setattr(resample, "pieces", lambda data: (data[a : a + 26] for a in range(0, len(data), 26)))
    cut = [b for _, f in resample.run_buckets(text, resample.Buckets(10_000), 3) for b in f]
    assert Counter(whole) == Counter(cut)


# --- hard negatives


def negative_rows(d=8):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, d)).astype(np.float32)
    x[40:60] = x[30]  # ties
    x[100] = 0
    rows = [(i, x[i].tolist(), int(rng.integers(0, 3)) if i % 3 else 1, 0) for i in range(300)]
    odd = [(300, None, 1), (301, [], 1), (302, [None] * d, 1), (303, [float("nan")] * d, 1), (304, [float("inf")] * d, 1)]
    odd += [(305, x[1].tolist(), None), (306, [1.0], 1), (None, x[0].tolist(), 1), (310, x[5].tolist(), 9)]
    return rows + [(*o, 0) for o in odd] + [rows[50]] * 3


def brute_negatives(rows, every):
    base = {}
    for i, v, label, _ in rows:
        if i is None or label is None or not v or len(v) != 8 or None in v or not np.isfinite(v).all():
            continue
        base[i] = (label, np.floor(256 * np.array(v, dtype=np.float64)))
    out = []
    for a in (a for a in base if a % every == 0):
        score = {i: int(base[a][1] @ v) for i, (_, v) in base.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if base[i][0] == base[a][0]][:5]:
            fit = [i for i in order if base[i][0] != base[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit[:3])]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [16_384, 50, 7])
def test_negatives(spark, block_rows):
    rows = negative_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, block int").repartition(3)
    from pyspark.sql import functions as F

    got = negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, block_rows=block_rows)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 5)
    if block_rows == 7:
        assert negatives.hard_negatives(df.where("vec_id < 0"), F.col("vec_id") % 5 == 0).count() == 0
        assert negatives.hard_negatives(df.where("label = 9"), F.col("vec_id") % 5 == 0).count() == 0


def test_threshold_stops_early_and_scores_are_exact():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * rng.normal(size=(4000, 3)))
    block = negatives.Block(np.arange(4000), np.zeros(4000, dtype=np.int64), rows)
    scored = []
    plain = block.scores
    block.scores = lambda at, q: scored.append(len(at)) or plain(at, q)
    (at, scores), = block.search(-1, rows[0], np.ones(4000, dtype=bool), [(-(1 << 62), 1 << 62)], 5)
    truth = (rows @ rows[0]).astype(np.int64)
    assert scores.tolist() == sorted(truth.tolist(), reverse=True)[:5] and sum(scored) < 2000
    huge = np.array([[3.0e9, 1.0], [1.0, -3.0e9]])
    block = negatives.Block(np.arange(2), np.zeros(2, dtype=np.int64), huge)
    assert block.scores(np.array([0, 1]), huge[0]).tolist() == [9 * 10**18 + 1, 0]
    with pytest.raises(OverflowError):
        block.scores(np.array([0]), 4 * huge[0])
