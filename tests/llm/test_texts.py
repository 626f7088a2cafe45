"""Text operators against brute force, with nulls, ties, empty tables and clashing columns."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from matchloom.llm import bitplane, bpe, chat, packing, pii, quality, simhash, substring
from matchloom.llm.queries import ORACLES, QUERIES
from matchloom.session import shared_dir

WORDS = ["alpha", "Beta", "gamma", "delta", "é", "zeta,", "eta", "theta"]
DOCS = "doc_id long, text string, lang string, source string, n_chars int, n_words int, marks string"


def corpus(seed=1):
    rnd = random.Random(seed)
    say = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 60)) for _ in range(n))
    shared, base = say(50), say(300)
    texts = [None, "", "  \n", "one", "one", "two words", base, base, base.replace(" ", "\n", 3)]
    texts += [say(40) + " " + shared + " " + say(30), shared + " " + say(10), "x " * 120, say(20)]
    near = base.split()
    for i in range(6):
        texts.append(" ".join([*near[: 40 * i], "changed", *near[40 * i + 1 :]]))
    texts.append("Der " * 5000 + base)
    return [(i, t) for i, t in enumerate(texts)] + [(None, "lost row"), (12, texts[12])]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}", len(t or ""), 7, "m") for d, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def brute_repeats(rows, window=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("places", [20_000, 2])
def test_repeats(spark, rows, places, monkeypatch):
    monkeypatch.setattr(substring, "PLACES", places)
    df = frame(spark, rows)
    got = substring.remove_repeats(df)
    assert set(df.columns) <= set(got.columns)
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()]
    assert sorted(found, key=key) == sorted(brute_repeats(rows), key=key)
    assert substring.remove_repeats(df.where("doc_id < 0")).count() == 0


def test_marks_of_a_shared_passage_grow_with_its_documents(spark, monkeypatch):
    rnd = random.Random(8)
    say = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    shared, counts = say(120), []
    made = substring._compared
    monkeypatch.setattr(substring, "materialise", lambda df, name: df)
    for n in (100, 400):
        sizes = []

        def counted(places):
            out = made(places).cache()
            sizes.append((places.count(), out.where("not again").count()))
            return out

        monkeypatch.setattr(substring, "_compared", counted)
        df = spark.createDataFrame([(i, f"{say(20)} {shared} {say(20)}") for i in range(n)], "key long, text string")
        assert substring.repeated_windows(df).count() == n
        places, marks = sizes[0]
        assert marks <= places
        counts.append(marks)
    assert counts[1] <= 4.2 * counts[0]


def test_a_line_said_over_and_over_is_compared_once_a_document(spark, monkeypatch):
    rnd = random.Random(12)
    say = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    made, counts = substring._compared, []

    def counted(places):
        out = made(places).cache()
        counts.append((places.count(), out.count()))
        return out

    monkeypatch.setattr(substring, "_compared", counted)
    for times in (30, 300):
        # pairs of words, longer lines, one in a single document, and the same with a gap that no other document has
        rows = [(i, f"{say(9)} {'ab cd ' * (times + i)} {say(40)}") for i in range(20)]
        rows += [(20 + i, f"{say(9)} {'one line of seven words it is ' * (times - i)}") for i in range(5)]
        rows += [(30, "only here " * times), (31, f"{'ab cd ' * times} {say(1)} {'ab cd ' * times}"), (32, "ab cd " * 18)]
        got = substring.remove_repeats(frame(spark, rows))
        found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()]
        assert sorted(found) == sorted(brute_repeats(rows))
    assert max(max(c) for c in counts) < 4 * len(rows), counts  # whatever the number of times


def brute_components(rows):
    fps = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                group = [group[j] if g == group[i] else g for g in group]
    first = {g: min((d for (d, _), h in zip(rows, group) if h == g and d is not None), default=None) for g in group}
    return [(d, f"{f:016x}", first[g]) for (d, _), f, g in zip(rows, fps, group)]


def test_near_duplicates(spark, rows):
    df = frame(spark, rows)
    got = [(r.doc_id, f"{r.fingerprint % 2**64:016x}", r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)
    assert simhash.near_duplicates(df.where("doc_id < 0")).count() == 0
    kept = sorted((r.doc_id for r in simhash.keep_one(df).collect()), key=lambda d: (d is None, d))
    assert kept == [*sorted({c for d, _, c in got if d is not None}), None]


def _similar_rows():
    """Twelve unrelated texts, each with copies of known word edits, and rows the operator must bear."""
    rnd = random.Random(3)
    rows, doc = [], 0
    for base in range(12):
        words = [f"w{rnd.randint(0, 4000)}" for _ in range(300)]
        for edits in (0, 0, 2, 5, 60):
            changed = list(words)
            for at in rnd.sample(range(300), edits):
                changed[at] = f"new{rnd.randint(0, 9999)}"
            rows.append((100 * base + edits + (1 if doc % 5 == 1 else 0), " ".join(changed)))
            doc += 1
    return rows + [(5000, None), (5001, ""), (5002, "one two"), (None, rows[0][1]), (5002, rows[5][1])]


def _jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_similar_documents_against_exact_similarity(spark):
    rows = _similar_rows()
    got = dict(simhash.similar_documents(frame(spark, rows)).collect())
    assert set(got) == {d for d, _ in rows if d is not None}
    assert got[5000] == got[5001] == 5000 and got[5002] == 100
    plain = [(d, t) for d, t in rows if d is not None and d < 5000]
    for i, (d, t) in enumerate(plain):
        for e, u in plain[:i]:
            f, g = (np.array(simhash._wide(x, 5, 42)).view(np.uint64) for x in (t, u))
            bits = int(np.bitwise_count(f ^ g).sum(dtype=np.int64))
            if bits <= simhash.wide_distance(0.8) or _jaccard(t, u) >= 0.9:
                assert got[d] == got[e], (d, e, bits)
            if _jaccard(t, u) < 0.5:
                assert got[d] != got[e], (d, e)
    kept = [r.doc_id for r in simhash.keep_similar(frame(spark, rows)).collect()]
    assert sorted(kept, key=lambda d: (d is None, d)) == sorted(set(got.values())) + [None]
    empty = frame(spark, rows).where("false")
    assert simhash.similar_documents(empty).count() == 0 and simhash.keep_similar(empty).count() == 0


def test_similar_links_of_crowded_cells(spark, monkeypatch):
    rows = [(d, t) for d, t in _similar_rows() if d is not None]
    whole = dict(simhash.similar_documents(frame(spark, rows)).collect())
    monkeypatch.setattr(simhash, "BLOCK", 1)
    assert dict(simhash.similar_documents(frame(spark, rows)).collect()) == whole


def test_wide_fingerprint_is_the_majority_of_distinct_shingles():
    text = "A b c d e f g h " * 3
    assert simhash._wide(text, 5, 42) == simhash._wide("a b c d e f g h a b c d", 5, 42)
    assert simhash._wide(None, 5, 42) == simhash._wide(" ", 5, 42) == [0] * simhash.WIDE
    assert simhash._wide("one two", 5, 42) != simhash._wide("one", 5, 42)
    assert simhash.wide_distance(0.8) == 44 and simhash.wide_distance(1.0) == 0
    assert simhash.grid_size(10, 0.8)[0] == 14 < simhash.grid_size(10**9, 0.8)[0]


def test_dense_groups_give_no_pairs(spark):
    centre, rnd = 0x0123456789ABCDEF, random.Random(2)
    fps = {centre ^ sum(1 << b for b in rnd.sample(range(20), 2)) for _ in range(400)}
    df = spark.createDataFrame([(f,) for f in fps], "fingerprint long")
    links = simhash.fingerprint_links(df).collect()
    assert len(links) <= 71 * len(fps)
    found = {r.component for r in simhash.components(simhash.fingerprint_links(df)).collect()}
    assert found == {min(fps)}


@pytest.mark.parametrize("distance", [4, 3, 1, 0])
def test_large_cells_are_divided(spark, distance):
    rnd = random.Random(distance)
    base = 0x3A5C0F9617E2D4B8
    fps = {(base & ~0xFFFFFF) | rnd.getrandbits(24) for _ in range(1200)}  # five groups of bits are all equal
    fps |= {f ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(1, 6))) for f in rnd.sample(sorted(fps), 300)}
    fps |= {rnd.getrandbits(63) for _ in range(500)}
    values = np.array(sorted(fps), dtype=np.uint64)
    least = {}
    left = set(range(len(values)))
    while left:  # breadth first over all pairs
        found = [min(left)]
        for i in found:
            near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= distance)
            found += [int(j) for j in near if j in left and j not in found]
        left -= set(found)
        least.update({int(values[i]): int(values[found].min()) for i in found})
    df = spark.createDataFrame([(int(f),) for f in values], "fingerprint long").repartition(5)
    want = {f: c for f, c in least.items() if f != c}
    for cell in (40, 10**6):
        links = simhash.fingerprint_links(df, distance=distance, cell=cell)
        assert {r.node: r.component for r in simhash.components(links).collect()} == want, cell


def test_parts_of_large_cells_are_bounded(spark):
    fps = np.arange(1 << 17, dtype=np.uint64) | np.uint64(0x5A << 40)
    cell = np.full(len(fps), simhash._signed(0x00001500AAAAAAAA), dtype=np.int64)
    batch = pa.record_batch([pa.array(cell), pa.array(fps.view(np.int64))], names=["cell", "a"])
    parts = list(simhash._divide(4)([batch]))
    assert len(parts) == 70
    for part in parts:
        assert max(np.unique(part.column(0).to_numpy(), return_counts=True)[1]) <= 1 << 16


def test_rounds_leave_the_last_one_only(spark):
    root = shared_dir(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    found = simhash.components(spark.range(30).selectExpr("id a", "id + 1 b"))
    assert {r.component for r in found.collect()} == {0} and found.count() == 30
    assert len(set(os.listdir(root)) - before) == 1


def test_pseudonyms(spark):
    values = ["die.55@mail4.example.com", "DIE.55@MAIL4.EXAMPLE.COM", "+1 (017) 555-7713", "4111 1111 1111 1111",
              "4111111111111111", "233.254.104.120", "04dbebab91ab85687d33eeaaf9ac699e1188f962",
              "DE89 3704 0044 0532 0130 00", "123-45-6789", "2024-02-29", "29.02.2024", "02/29/2024"]
    clean = ["31.02.2024", "Version 2.0.", "4111111111111112", "a\x01b \x01\x03", "", None]
    df = spark.createDataFrame([(i, f"see {v} now {v}") for i, v in enumerate(values)] + [(100 + i, v) for i, v in enumerate(clean)], "doc_id int, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    new = []
    for i, v in enumerate(values):
        text = got[i].text
        assert v not in text and got[i].n_replaced == 2
        parts = text[4:].split(" now ")
        assert parts[0] == parts[1]
        new.append(parts[0])
        if i != 5:
            assert [c.isdigit() for c in parts[0]] == [c.isdigit() for c in v] or i in (6, 7)
    assert new[0].upper() == new[1] and new[3].replace(" ", "") == new[4]
    assert sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(new[4]))) % 10 == 0
    y, m, d = new[9].split("-")
    assert new[10] == f"{d}.{m}.{y}" and new[11] == f"{m}/{d}/{y}"
    assert [got[100 + i].text for i in range(len(clean))] == clean
    assert pii.pseudonymise(df.where("doc_id < 0"), "key").count() == 0


def test_permutations_are_one_to_one(spark):
    df = spark.range(1000).selectExpr("lpad(id, 3, '0') as v", "id")
    from pyspark.sql import functions as F

    assert df.select(pii.permuted(F.col("v"), "k", "t").alias("p")).distinct().count() == 1000
    number = pii.permuted_number(F.col("id"), "k", "t", 40, 26, 1000)
    assert sorted(r.p for r in df.select(number.alias("p")).collect()) == list(range(1000))


def brute_pack(items, capacity):
    bins, placed = [], {}
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        n, s, c = items[i]
        fits = [(capacity - sum(x[0] for x in b), k) for k, b in enumerate(bins)
                if n + sum(x[0] for x in b) <= capacity and not any((s >= 0 and x[1] == s) or (c >= 0 and x[2] == c) for x in b)]
        fits = [f for f in fits if f[0] > 0]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[k].append(items[i])
        placed[i] = k
    return [placed[i] for i in range(len(items))]


def test_packing(spark, rows):
    rnd = random.Random(4)
    items = [(rnd.randint(1, 50), rnd.choice([0, 0, 0, 1, 2, -1]), rnd.choice([-1, 0, 1, 2, 3])) for _ in range(300)]
    got = packing.pack_shard([i[0] for i in items], [i[1] for i in items], [i[2] for i in items], 64)
    assert [b for b, _ in got] == brute_pack(items, 64)
    df = frame(spark, rows).drop("n_words")
    out = packing.best_fit(packing.document_items(df), capacity=100, shard_items=8).collect()
    n_words = Counter()
    for d, t in rows:
        n_words[d] += len((t or "").split())
    total, bins = Counter(), {}
    for r in out:
        total[r.doc_id] += r.length
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    assert {k: v for k, v in total.items() if v} == {k: v for k, v in n_words.items() if v}
    for members in bins.values():
        assert sum(m.length for m in members) <= 100
        assert len({(m.doc_id or 0) % 3 for m in members}) == len(members)
        assert sorted(m.position for m in members) == list(range(len(members)))
    assert packing.best_fit(packing.document_items(df.where("doc_id < 0"))).count() == 0


def test_word_pieces(spark, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    rnd = random.Random(3)
    odd = ["ΑΣ ΣΑΣ İ", "<|endoftext|>a<|startoftext|> b", "x\x1cy\x85z\xa0w", "don't I'LL", "Õĺ՘b", "👩‍👧 ok", "a" * 3000]
    odd += ["".join(rnd.choice("abcdeinthrox.,'") for _ in range(rnd.randint(700, 1500))) for _ in range(20)]
    df = frame(spark, [*rows, *[(1000 + i, t) for i, t in enumerate(odd)]])
    for r in bpe.round_trip(df, path).join(df, "doc_id").select("text", "n_tokens", "ids", "decoded").collect():
        want = tool.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == tool.decode(want, skip_special_tokens=False)
    assert bpe.round_trip(df.where("doc_id < 0"), path).count() == 0


def test_lookahead_and_byte_decoder():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tool = bpe.Transducer(f.read())
    rnd = random.Random(5)
    for letters in ("ab", "aeinrst", "abcdefghijklmnop"):
        word = [rnd.choice(letters) for _ in range(4 * tool.lookahead)]
        whole = tool.merged([*word[:-1], word[-1] + tool.suffix])
        assert list(tool.stream(iter(word))) == whole
    merges = [("a", "b"), ("b", "c"), ("c", "d")]
    assert bpe.sufficient_lookahead(merges[::-1]) == 3 and bpe.sufficient_lookahead(merges) == 1
    tool.joined = False
    machine = tool.decoder()
    symbols = {s: i for i, s in enumerate(tool.symbols)}
    machine.tokens = {i: s for s, i in symbols.items()}
    text = "aé👩\x00"
    assert "".join(machine.feed([b]) for b in text.encode()) + machine.finish() == text


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_id_files(spark, rows, plane, tmp_path, monkeypatch):
    monkeypatch.setattr(bitplane, "ROW_IDS", 500)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    odd = ["a  b   c\n\n d \t e", " lead", "trail ", "a\x1c b", "<|endoftext|> x", "x \n y"]
    full = [r for r in [*rows, *[(1000 + i, t) for i, t in enumerate(odd)]]]
    df = frame(spark, full)
    bitplane.write_ids(df, f"{tmp_path}/ids", path, plane=plane)
    got = bitplane.read_ids(spark, f"{tmp_path}/ids").collect()
    want = Counter((d, np.array([*tool.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t in full)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    assert bitplane.round_trip(df.where("doc_id < 0"), path).count() == 0
    crc = {r.doc_id: r.ids_crc32 for r in bitplane.round_trip(df.where("doc_id = 9"), path).collect()}
    assert crc == {9: zlib.crc32(next(i for d, i in want if d == 9))}


def test_planes_of_any_length():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 7, 65536, 70001):
        ids = rnd.integers(0, 2**32, n, dtype=np.uint32)
        for plane in ("byte", "bit"):
            assert (bitplane.unpack_blocks(*bitplane.pack_blocks(ids, plane)) == ids).all()


def test_chats(spark):
    bad = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a <|im_end|>\n", "<|im_start|>", "<|other|>", None, "", "x<", "é👩"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(bad)]
    rows += [(2, 0, "odd\nrole\\n<|im_end|>", "t"), (2, None, None, "first"), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie")]
    rows += [(None, 1, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    chats = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(chats).collect()}
    for c in (1, 2, None):
        own = [("", r[2] or "", r[3] or "", r[1]) for r in rows if r[0] == c]
        own = sorted(own, key=lambda t: (t[3] is not None, t[3] or 0, t[1], t[2]))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, t) for _, r, t, _ in own]
        assert got[c].loss_text == "".join(t for _, r, t, _ in own if r == "assistant")
    for r in chats.collect():
        assert r.formatted.count("<|im_end|>") == got[r.conv_id].turns.__len__()
        assert got[r.conv_id].formatted_chars == len(r.formatted)
    assert chat.format_chats(df.where("conv_id < 0")).count() == 0


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op5_quality"](spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert all(rows[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in rows)
    held = [(rows[d].score, q) for d, q in labels if rows[d].held_out]
    right = np.mean([(s >= 0.7) == (q == 1) for s, q in held])
    assert right > 0.98, right
    assert np.mean([s < 0.7 for s, q in held if q == 1]) < 0.01


def test_quality_edges(spark, rows):
    df = frame(spark, rows)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_documents(df, labels).collect()} == {0.5}
    assert quality.keep_good(df, labels).count() == len(rows)
    some = spark.createDataFrame([(d, 1) for d in range(12)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    got = quality.score_documents(df, some).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_documents(df.where("doc_id < 0"), some).count() == 0


def test_prior_estimate():
    rng = np.random.default_rng(8)
    p = rng.normal(1, 1, (4000, 3))
    u = np.concatenate([rng.normal(1, 1, (4200, 3)), rng.normal(-2, 1, (1800, 3))])
    model = quality.fit_arrays(p, u)
    assert abs(model.prior - 0.7) < 0.08
    assert (model.score(u[4200:]) < 0.7).mean() > 0.95


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    from compare import compare, connect

    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), name, QUERIES[name], ORACLES[name], sf) is None




def _graded_rows():
    """Isolated pairs of known similarity, from 0.5 to 0.9 and many from 0.80 to 0.82."""
    rnd, rows = random.Random(11), []
    for pair in range(150):
        words = [f"p{pair}w{i}" for i in range(304)]
        changed, gap = list(words), 9  # places that share no shingle
        edits = 6 if pair < 60 else rnd.randint(3, 18)
        for at in rnd.sample(range(5, 299, gap), edits):
            changed[at] = f"new{pair}x{at}"
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(changed))]
    return rows


def test_isolated_pairs_link_by_exact_similarity(spark, monkeypatch):
    rows = _graded_rows()
    texts = dict(rows)
    alike = [_jaccard(texts[2 * p], texts[2 * p + 1]) for p in range(150)]
    assert all(0.80 <= j <= 0.82 for j in alike[:60]) and min(alike) < 0.6 and any(0.7 < j < 0.8 for j in alike)
    for shingles in (simhash.SHINGLES, 100):
        monkeypatch.setattr(simhash, "SHINGLES", shingles)
        got = dict(simhash.similar_documents(frame(spark, rows)).collect())
        linked = [got[2 * p] == got[2 * p + 1] for p in range(150)]
        assert not any(x for x, j in zip(linked, alike) if j < 0.8)
        # the grids are to bring 99 of 100 together
        assert sum(linked) >= sum(j >= 0.8 for j in alike) - 2


def test_no_group_holds_all_places_of_a_hot_anchor(spark, monkeypatch):
    rnd = random.Random(9)
    say = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    phrase, made, largest = say(20), substring._compared, []

    def counted(places):
        largest.append(places.groupBy("anchor", "salt").count().agg({"count": "max"}).first()[0] or 0)
        return made(places)

    monkeypatch.setattr(substring, "PLACES", 20)
    monkeypatch.setattr(substring, "_compared", counted)
    rows = [(i, f"{say(40)} {phrase} {say(40)}") for i in range(400)]
    rows += [(400 + i, rows[i][1] + f" end{i}") for i in range(3)]
    got = substring.remove_repeats(frame(spark, rows))
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()]
    assert sorted(found) == sorted(brute_repeats(rows)) and sum(r[2] > 0 for r in found) == 6
    assert max(largest) <= 100


def test_repeated_rows_are_one_text(spark, rows, monkeypatch):
    many = rows + [(3000, rows[12][1])] * 60 + [(None, rows[9][1])] * 60 + [(3001, "short one")] * 5 + [(3002, None)] * 3
    read, made = [], substring._compared

    def counted(places):
        read.append(places.count())
        return made(places)

    monkeypatch.setattr(substring, "_compared", counted)
    got = substring.remove_repeats(frame(spark, many))
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()]
    assert sorted(found, key=key) == sorted(brute_repeats(many), key=key)
    keyed = frame(spark, [(3000, rows[6][1])] * 200).selectExpr("doc_id as key", "text")
    marks = substring.repeated_windows(keyed).collect()
    assert [(r.key, [tuple(m) for m in r.marks]) for r in marks] == [(3000, [(0, 266)])]
    assert read[-1] < 266


def test_pseudonyms_of_numbers_with_something_behind(spark):
    card, amex, iban = "4111 1111 1111 1111", "3782 822463 10005", "ES91 2100 0418 4502 0005 1332"
    values = [(card, " 123"), (card, " 12/27"), (card, " 12.05.2027"), (amex, ""), (amex.replace(" ", "-"), " 123")]
    values += [(iban, " BIC"), (iban.replace(" ", ""), " 2024"), (iban, " 4111 1111 1111 1111"), (iban, "")]
    values += [("GB82 WEST 1234 5698 7654 32", " ABC"), ("DE89370400440532013000", " 12"), ("31/12/2024", ""), (card, " 5")]
    values += [("ZZ68 1234 5678 9012 345", " AB")]
    df = spark.createDataFrame([(i, f"pay {v}{rest}, then") for i, (v, rest) in enumerate(values)], "doc_id int, text string")
    got = [r.text for r in pii.pseudonymise(df, "key").orderBy("doc_id").collect()]
    new = []
    for (v, rest), text in zip(values[:13], got):
        assert text.startswith("pay ") and v not in text and text.endswith(", then"), (v, text)
        new.append(text[4 : 4 + len(v)])
        if "." not in rest and len(rest) < 10:
            assert text == f"pay {new[-1]}{rest}, then"
    assert new[0] == new[1] == new[2] == new[12] and "12.05.2027" not in got[2]
    assert new[3] == new[4].replace("-", " ") and new[5] == new[7] == new[8] and new[6] == new[5].replace(" ", "")
    assert got[7] == f"pay {new[5]} {new[0]}, then"
    plain = spark.createDataFrame([(0, "31.12.2024")], "doc_id int, text string")
    d, m, y = pii.pseudonymise(plain, "key").first().text.split(".")
    assert new[11] == f"{d}/{m}/{y}"


def _words_of_one_xxh64():
    """Two words of 32 letters and more whose XXH64 of seed 0 is equal: a change of the first eight bytes is undone in the
    lane by the next block."""
    one, two, full = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 2**64 - 1
    turn = lambda v: ((v << 31) | (v >> 33)) & full
    state = lambda block: turn(one + two + int.from_bytes(block, "little") * two & full) * one & full
    rnd, first = random.Random(5), b"abcdefgh"
    while True:
        other = bytes(rnd.choices(range(97, 123), k=8))
        then = int.from_bytes(b"ijklmnop", "little") + (state(first) - state(other)) * pow(two, -1, 2**64) & full
        then = then.to_bytes(8, "little")
        if all(33 <= b < 127 for b in then):
            pair = [a + b"x" * 24 + b + b"y" * 24 for a, b in ((first, b"ijklmnop"), (other, then))]
            assert pair[0] != pair[1] and xxhash.xxh64_digest(pair[0]) == xxhash.xxh64_digest(pair[1])
            return [w.decode() for w in pair]


@pytest.mark.parametrize("places", [20_000, 1])
def test_windows_of_words_that_share_a_hash_differ(spark, places, monkeypatch):
    monkeypatch.setattr(substring, "PLACES", places)
    a, b = _words_of_one_xxh64()
    rest = " ".join(f"w{i}" for i in range(60))
    rows = [(0, f"{rest} {a} {rest[::-1]}"), (1, f"{rest[:70]} {a} {rest[:100]}"), (2, f"{rest[:70]} {b} {rest[:100]}")]
    rows += [(3, f"{a} " * 40), (4, f"{b} " * 34)]
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(found) == sorted(brute_repeats(rows))


def test_windows_equal_in_one_of_their_numbers_differ():
    def rows(*windows):
        pack = [np.array(w, dtype=np.uint64).tobytes() for w in windows]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*[(7, 0, 1, k, 0, w) for k, w in enumerate(pack)]), substring._PLACES)], schema=substring._PLACES)

    marks = lambda *w: [r["key"] for b in substring._compare([rows(*w)]) for r in b.to_pylist()]
    assert marks([(5, 1)], [(5, 2)]) == [] and marks([(5, 1)], [(6, 1)]) == []
    assert marks([(5, 1)], [(5, 2)], [(5, 1)]) == [0, 2]


def test_cells_of_similar_links_hold_segment_counts(spark):
    rnd = np.random.default_rng(4)
    fps = rnd.integers(0, 2**64, (40, simhash.WIDE), dtype=np.uint64)
    low = np.uint64(0x5555555555555555)
    turned = ((fps & low) << np.uint64(1)) | ((fps >> np.uint64(1)) & low)  # 01 for 10: the same counts, many bits apart
    rows = [(k, *[int(v) for v in f.view(np.int64)]) for k, f in enumerate([*fps, *turned])]
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(f"{w} long" for w in simhash._WORDS))
    points = [simhash.F.struct(*[simhash.embedding(simhash.F.col(w)).alias(w) for w in simhash._WORDS]).alias("_points")]
    cells = dict(nodes.select("node", *points).select("node", simhash._wide_cells(*simhash.grid_size(80, 0.8))).collect())
    assert all(cells[k] == cells[40 + k] for k in range(40)) and len({tuple(c) for c in cells.values()}) == 40
    # half of the bits differ: candidates of a cell are still told apart by their bits
    assert simhash.similar_links(nodes).count() == 0


def test_grids_are_one_function_in_the_plan(spark):
    nodes = spark.createDataFrame([(1, 2, 3, 4, 5)], "node long, f0 long, f1 long, f2 long, f3 long")
    points = simhash.F.struct(*[simhash.F.col(w) for w in simhash._WORDS]).alias("_points")
    few, many = (nodes.select(points).select(simhash._wide_cells(14, n)) for n in (2, 150))
    size = lambda df: len(df._jdf.queryExecution().analyzed().toJSON())
    assert size(many) < 1.1 * size(few)  # whatever the number of grids
    assert [len(df.first()[0]) for df in (few, many)] == [2, 150]


def test_sample_of_features_comes_without_an_object_per_number(spark):
    import tracemalloc

    rows = spark.range(3000).selectExpr("id AS doc_id", "transform(sequence(1, 75), i -> CAST(id + i / 8 AS float)) AS features")
    tracemalloc.start()
    try:
        got = quality._sample(rows, 5000, 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.shape == (3000, 75) and got.dtype == np.float64
    assert sorted(got[:, 0]) == [k + 1 / 8 for k in range(3000)] and (got[:, 74] - got[:, 0] == 74 / 8).all()
    assert peak < 20 * got.size, peak
    assert not len(quality._sample(rows.where("doc_id < 0"), 5000, 1))


def test_groups_of_places_are_compared_at_once(monkeypatch):
    rnd, sorts, sort = np.random.default_rng(2), [], np.argsort
    monkeypatch.setattr(substring.np, "argsort", lambda *a, **k: sorts.append(1) or sort(*a, **k))
    # (anchor, salt, salts) and windows in few numbers, so that some agree in one number only
    rows, want, again = [], set(), {}
    for place in range(900):
        anchor = place // 3
        salts = 1 + anchor % 2
        rows.append((anchor, place % salts, salts, place, int(rnd.integers(0, 99)), rnd.integers(0, 4, (5, 2)).astype(np.uint64)))
    rows.sort(key=lambda r: r[:2])
    for a, s, n, key, start, pack in rows:
        here = [tuple(w) for b, t, *_, p in rows if (b, t) == (a, s) for w in p.tolist()]
        want |= {(key, start + i) for i, w in enumerate(pack.tolist()) if here.count(tuple(w)) > 1}
        if n > 1:
            again[a, s] = set(here)
    for size in (900, 7):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*[(*r[:5], r[5].tobytes()) for r in part]), substring._PLACES)], schema=substring._PLACES) for part in cut]
        sorts.clear()
        marks = [r for b in substring._compare(iter(batches)) for r in b.to_pylist()]
        assert {(r["key"], w) for r in marks if not r["again"] for w in range(r["start"], r["stop"])} == want
        salt = {r[3]: r[1] for r in rows}
        handed = sorted((r["anchor"], salt[r["key"]], w) for r in marks if r["again"] for w in zip(r["windows"], r["checks"]))
        assert handed == sorted((*g, w) for g, ws in again.items() for w in ws)  # one place each
        assert len(sorts) <= len(batches) + 1


def test_links_of_a_family_do_not_grow_with_the_grids(spark, monkeypatch):
    rnd = random.Random(11)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(400)]
    rows = []
    for i in range(200):
        words = list(base)
        for _ in range(3):
            words[rnd.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(words)))
    found, links = simhash.components, []

    def counted(edges):
        links.append(edges.count())
        return found(edges)

    monkeypatch.setattr(simhash, "components", counted)
    assert set(dict(simhash.similar_documents(frame(spark, rows)).collect()).values()) == {0}
    assert sum(links) <= 10 * len(rows)


def test_families_do_not_depend_on_the_first_grids(spark, monkeypatch):
    rows = [(d, t) for d, t in _similar_rows() if d is not None]
    got = []
    for first in (1, 10_000):
        monkeypatch.setattr(simhash, "FIRST_GRIDS", first)
        got.append(dict(simhash.similar_documents(frame(spark, rows)).collect()))
    assert got[0] == got[1]


def test_no_similar_pair_is_left_to_chance(spark, monkeypatch):
    rows = _graded_rows()
    rnd = random.Random(23)
    for pair in range(150, 250):  # short texts, whose fingerprints spread wide, one word changed at an end
        words = [f"p{pair}w{i}" for i in range(rnd.randint(9, 40))]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join([*words[:-1], "other"]))]
    rows = [(d, t + " one common passage of many words that all of these texts hold") if d >= 400 else (d, t) for d, t in rows]
    texts = dict(rows)
    alike = [_jaccard(texts[2 * p], texts[2 * p + 1]) >= 0.8 for p in range(250)]
    assert 100 < sum(alike) < 250
    monkeypatch.setattr(simhash, "grid_size", lambda *_: (60, 1))  # hardly any pair shares a cell
    got = dict(simhash.similar_documents(frame(spark, rows)).collect())
    assert [got[2 * p] == got[2 * p + 1] for p in range(250)] == alike
