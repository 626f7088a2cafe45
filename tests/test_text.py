from pyspark.sql import functions as F

from matchloom.functions import text as X


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


ODD = [
    "a\x1c b\x1d\x1e\x85c   x  \x0b y\x0cz\r\n\r q　  ",
    " \x1f ",
    "\n\n",
    "",
    "one",
    " lead\ttab \n  - b  \n",
    "a" + " " * 5000 + "b\n" + " " * 5000 + "\nc",
]


def test_lines_split_like_python(spark):
    got = values(spark, ODD, X.lines("t"))
    assert got == [[p.strip() for p in t.splitlines() if p.strip()] for t in ODD]


def test_strip_like_python(spark):
    assert values(spark, ODD, X.strip("t")) == [t.strip() for t in ODD]


def test_title_case_like_python(spark):
    texts = ["machine learning", "what's ML-ops", "3d MODEL", "été à paris", ""]
    assert values(spark, texts, X.title_case("t")) == [t.title() for t in texts]


def test_upper_and_title_lines_like_python(spark):
    texts = ["WORK HISTORY", "Work History", "work history", "A", "Ärger Groß", "X" * 41, "12 34", "What'S Up", "aB", "É1 Ö2"]
    upper = values(spark, texts, X.upper_line_count("t"))
    title = values(spark, texts, X.title_line_count("t"))
    assert upper == [int(len(t) <= 40 and t.isupper()) for t in texts]
    assert title == [int(len(t) <= 40 and t.istitle() and not t.isupper()) for t in texts]


def test_token_endings(spark):
    pairs = {
        "king": "king", "being": "be", "sing": "sing", "bed": "bed", "used": "us", "red": "red",
        "does": "doe", "boxes": "box", "yes": "yes", "cats": "cat", "gas": "gas", "ing": "ing", "s": "s",
        "designing": "design", "pipelines": "pipelin", "process": "proces",
    }
    words = list(pairs)
    assert values(spark, words, X.normalise_token("t")) == list(pairs.values())
    assert values(spark, words, X.tokens("t")) == [[v] for v in pairs.values()]


def test_tokens_of_texts(spark):
    texts = ["Cats, CATS; dogs!", "  ", "", None, "C++ & C# (v2)", "tab\tsep　wide\nline"]
    got = values(spark, texts, X.tokens("t"))
    assert got == [["cat", "dog"], [], [], [], ["c", "v2"], ["tab", "sep", "wide", "line"]]


def test_syllables(spark):
    counts = {"the": 1, "tree": 1, "make": 1, "table": 1, "area": 2, "rhythm": 1, "bcd": 1, "example": 2, "e": 1, "be": 1, "queue": 1, "a": 1, "idea": 2}
    assert values(spark, list(counts), X.syllable_count("t")) == list(counts.values())
    assert values(spark, [" ".join(counts), ""], X.syllable_count("t")) == [sum(counts.values()), 0]


def test_word_counts(spark):
    df = spark.createDataFrame([(["a b", "", " x\t y  z ", "one"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(X.word_counts(F.col("t"))).collect()] == [[2, 0, 3, 1], []]


def test_redact_spans(spark):
    rows = [
        ("hello world", [(6, 11)], "hello [REDACTED]"),
        ("hello world", [(6, 11), (0, 5)], "[REDACTED] [REDACTED]"),
        ("abcdef", [(0, 4), (2, 3)], "[REDACTED][REDACTED]def"),
        ("abc", [], "abc"),
        ("", [(0, 1)], ""),
    ]
    df = spark.createDataFrame(
        [(i, t, s) for i, (t, s, _) in enumerate(rows)], "i int, t string, s array<struct<begin:int,end:int>>"
    )
    got = [r[0] for r in df.orderBy("i").select(X.redact_spans("t", "s")).collect()]
    assert got == [r[2] for r in rows]


def test_personal_data(spark):
    texts = ["mail a.b@c.io now", "call 415-555-0199", "(415) 555 0199", "+1 415 555 0199", "12345", "no@mail"]
    assert values(spark, texts, X.has_email("t")) == [True, False, False, False, False, False]
    assert values(spark, texts, X.has_phone("t")) == [False, True, True, True, False, False]
    assert values(spark, texts[:1], X.redact_patterns("t")) == ["mail [REDACTED] now"]


def test_skill_words_and_escape(spark):
    assert values(spark, ["Use SQL and c++ C++ with Python, a B x"], X.skill_words("t")) == [["C++", "Python", "SQL", "Use"]]
    assert values(spark, ['<a href="x">&</a>'], X.escape_xml("t")) == ["&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"]


def test_endings_and_syllables_of_many_words(spark):
    import random
    import re

    from pyspark.sql import functions as F

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("aeiyngsdtE1é") for _ in range(rng.randint(1, 8))) for _ in range(4000)})
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = df.select("t", X.tokens("t").alias("a"), X.normalise_token(F.lower("t")).alias("b"), X.syllable_count("t").alias("n")).collect()
    assert all(r.a == [r.b] for r in got)

    def syllables(word):
        groups = re.findall("[aeiouy]+", word.lower())
        return max(len(groups) - (word.lower().endswith("e") and len(groups) > 1), 1)

    assert [r.n for r in got] == [syllables(r.t) for r in got]
    text = "  " + " \t\n ".join(words) + " "
    one = spark.createDataFrame([(text,), (" ",)], "t string").select(X.syllable_count("t"), X.word_counts(F.array("t"))[0]).collect()
    assert [tuple(r) for r in one] == [(sum(map(syllables, words)), len(words)), (0, 0)]
