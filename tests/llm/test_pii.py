"""Pseudonyms against a plain Python version, and the cases that lengths, names of columns and forms make hard."""

import datetime as dt
import hashlib

import pytest
import regex

from matchloom.llm import pii

KEY = "k"
FIRST = dt.date(1900, 1, 1)


def stream(kind, other, step, blocks):
    return "".join(hashlib.sha256(f"{KEY}|{kind}|{step}|{other}|{i}".encode()).hexdigest() for i in range(blocks))


def moved(c, by, hexadecimal):
    if hexadecimal:
        return f"{(int(c, 16) + by) % 16:x}"
    for low, high in pii._CLASSES:
        if low <= ord(c) <= high:
            return chr((ord(c) - low + by) % (high - low + 1) + low)
    return c


def permuted(value, kind, hexadecimal=False):
    halves = [value[: len(value) // 2], value[len(value) // 2 :]]
    for step in range(pii.ROUNDS):
        at = 1 - step % 2
        half, other = halves[at], halves[1 - at]
        if half:
            s = stream(kind, other, step, (len(half) - 1) // 16 + 1)
            halves[at] = "".join(moved(c, int(s[4 * i : 4 * i + 4], 16), hexadecimal) for i, c in enumerate(half))
    return "".join(halves)


def permuted_number(x, kind, high, low, size):
    while True:
        a, b = divmod(x, low)
        for step in range(pii.ROUNDS):
            number = int(stream(kind, b if step % 2 else a, step, 1)[:12], 16)
            a, b = ((a + number % high) % high, b) if step % 2 else (a, (b + number % low) % low)
        x = a * low + b
        if x < size:
            return x


def refilled(form, new, takes=str.isdigit):
    new = iter(new)
    return "".join(next(new) if takes(c) else c for c in form)


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def folded(value, change):
    new = change(value.lower())
    return new.upper() if value == value.upper() != value.lower() else new


def card(value):
    digits = regex.sub("[^0-9]", "", value)
    body = permuted(digits[:-1], "card")
    return refilled(value, body + str(-luhn(body + "0") % 10))


def remainder(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(value):
    plain = value.replace(" ", "")
    account = permuted(plain[4:], "iban")
    return refilled(value, plain[:2] + f"{98 - remainder(account + plain[:2] + '00'):02d}" + account, lambda c: c != " ")


def date(value):
    for form, start in (("%B %-d, %Y", pii._MONTHS), ("%b %-d, %Y", f"(?!May )(?:{pii._SHORT})"), ("%Y-%m-%d", "[0-9]{4}-"),
                        ("%d.%m.%Y", r"[0-9]{2}\."), ("%m/%d/%Y", "(?:0[0-9]|1[0-2])/"), ("%d/%m/%Y", "(?:1[3-9]|[2-9][0-9])/")):
        if regex.match(f"(?:{start})", value):
            try:
                day = (dt.datetime.strptime(value, form.replace("%-d", "%d")).date() - FIRST).days
            except ValueError:
                return value
            new = permuted_number(day, "date", pii._HIGH, pii._LOW, pii._DAYS) if 0 <= day < pii._DAYS else None
            return value if new is None else (FIRST + dt.timedelta(new)).strftime(form)
    return value


def address(value):
    o = [int(x) for x in value.split(".")]
    a, b = o[0] * 256 + o[1], o[2] * 256 + o[3]
    for step in range(pii.ROUNDS):
        by = int(stream("address", b if step % 2 else a, step, 1)[:12], 16) % 65536
        a, b = ((a + by) % 65536, b) if step % 2 else (a, (b + by) % 65536)
    return ".".join(map(str, (a // 256, a % 256, b // 256, b % 256)))


def pseudonym(v):
    is_all = lambda p: regex.fullmatch(p, v) is not None
    digits = regex.sub("[^0-9]", "", v)
    if "@" in v:
        return folded(v, lambda x: permuted(x.split("@")[0], "email") + "@" + x.rsplit("@", 1)[1])
    if ":" in v and is_all(pii.ADDRESS6):
        new = refilled(v, permuted(v.replace(":", "").lower(), "address6", True), lambda c: c != ":")
        return new.upper() if v == v.upper() != v.lower() else new
    heads = regex.match("AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xoxb-", v)
    if is_all("[0-9a-fA-F]{32,}") and regex.search("[a-fA-F]", v) and regex.search("[0-9]", v):
        return folded(v, lambda x: permuted(x, "secret", True))
    if heads:
        return heads[0] + permuted(v[heads.end() :], "secret")
    if regex.match("[A-Z]{2}[0-9]{2}", v):
        groups = v.split(" ")
        for n in range(len(groups), 0, -1):
            part = " ".join(groups[:n])
            plain = part.replace(" ", "")
            if 15 <= len(plain) <= 34 and remainder(plain[4:] + plain[:4]) == 1:
                return iban(part) + v[len(part) :]
        return v
    if is_all(pii.ADDRESS):
        return address(v)
    if is_all(pii.DATE) or is_all(pii.NAMED_DATE):
        return date(v)
    if is_all(pii.PHONE):
        code = regex.match(r"\+[0-9]{1,3}(?=[ .(-])", v)
        head = code[0] if code else ""
        rest = v[len(head) :]
        return head + refilled(rest, permuted(regex.sub("[^0-9]", "", rest), "phone"))
    if is_all(pii.SOCIAL):
        return refilled(v, permuted(digits, "social"))
    if is_all(pii.CARD):
        four = regex.match("[0-9]{4}(?:[ -][0-9]{4}){3}(?=[ -])", v)
        for part in ([four[0]] if four else []) + [v]:
            d = regex.sub("[^0-9]", "", part)
            if 13 <= len(d) <= 19 and luhn(d) == 0:
                return card(part) + v[len(part) :]
    return v


def brute(text):
    if text is None:
        return None, 0
    count = 0

    def change(m):
        nonlocal count
        new = pseudonym(m[0])
        count += new != m[0]
        return new

    return regex.sub(pii.ANY, change, text), count


LONG = ["sk-" + "aB3" * 40, "0a1b" * 35, "x" * 70 + "y@mail.com", "0A" * 3000, "ghp_" + "Zz9" * 400]
FORMS = ["555 123 4567", "030 1234567", "Feb 28, 2024", "February 28, 2024", "May 5, 2024", "2001:0db8:85a3:0000:0000:8a2e:0370:7334",
         "fe80::1ff:fe23:4567:890a", "FE80::1", "+49 30 1234567", "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "10.0.0.1"]
CLEAN = ["std::cout", "12:30:45", "abc::def", "Feb 30, 2024", "12 555 123 4567 8", "a@b", "sk-short", "Version 2.0", "\x01\x02 \x01\x03 1"]


def test_documents_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.text, r.n_replaced) for r in pii.pseudonymise(docs, KEY).collect()}
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert sum(n for _, n in want.values()) > 5 and got == want


def test_values_against_plain_python(spark):
    texts = [f"see {v}, then {v}." for v in LONG + FORMS] + CLEAN + [None, "", "x " * 200_000 + "die@mail.com", "." * 5000 + "a@" + "b." * 5000 + "com"]
    rows = [(i, t, "a", "b", "c", 7) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id int, text string, _old string, _parts string, rest string, n_replaced int")
    out = pii.pseudonymise(df, KEY)
    assert out.columns == ["doc_id", "text", "_old", "_parts", "rest", "n_replaced"]
    got = out.collect()
    assert len(got) == 2 * len(texts) and all((r._old, r._parts, r.rest) == ("a", "b", "c") for r in got)
    for r in got:
        assert (r.text, r.n_replaced) == brute(texts[r.doc_id]), texts[r.doc_id][:60]
    for r in got:
        if r.doc_id < len(LONG + FORMS):
            assert r.n_replaced == 2 and (LONG + FORMS)[r.doc_id] not in r.text
        elif r.doc_id < len(LONG + FORMS + CLEAN):
            assert r.n_replaced == 0


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([(1, "a")], "doc_id int, text string"), "")
