"""Format-preserving pseudonyms for personal data, in column expressions only.

Found values are validated (card check digit, account number remainder, calendar date, address octets) and permuted
under a key within their own format by a Feistel network: the two halves of a value are moved in turn by a keyed hash
of the other half, each character inside its own class (digit, small letter, capital). That is a permutation of all
values of the format, so equal values get equal pseudonyms in every document and different ones stay different.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.rows import settle

ROUNDS = 8
# A mark cannot be mistaken for text: \x01 of the text is written \x01\x02 until the end.
_ESC, _KEPT, _MARK = "\x01", "\x01\x02", "\x01\x03"

# lengths have no upper bound; loops run over single characters, so that long values need no stack
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-][\p{L}\p{N}.-]*\.\p{L}{2,63}"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,}+|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp_|gho_|sk-|sk_live_|xoxb-)[0-9A-Za-z_-]{16,}+)(?![0-9A-Za-z])"
#: Countries by the length of their account numbers.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account(length: int) -> str:
    fours, rest = divmod(length - 4, 4)
    return f"(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


# of a known country its own length first, so that what follows is not taken; then any other
_KNOWN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}{_account(n)}" for n, c in _LENGTHS.items())
IBAN = (
    rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{_KNOWN})(?![0-9A-Za-z])"
    r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
)
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
ADDRESS = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
_GROUP = r"[0-9A-Fa-f]{1,4}"
ADDRESS6 = (
    rf"(?<![0-9A-Za-z:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[A-Fa-f:]*[0-9])(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![0-9A-Za-z:]|\.[0-9])"
)
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_SHORT = "|".join(m[:3] for m in _MONTHS.split("|"))
NAMED_DATE = rf"(?<![\p{{L}}\p{{N}}])(?:{_MONTHS}|{_SHORT}) [0-9]{{1,2}}, [0-9]{{4}}(?![0-9])"
DATE = (
    r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])"
)
PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
    r"|(?<![0-9] )(?:[0-9]{3} [0-9]{3} [0-9]{4}|0[1-9][0-9]{1,3}[ /][0-9]{5,8})(?! [0-9]))(?![0-9])"
)
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
# a last group that begins a date, an expiry or an address is not taken
CARD = (
    r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}"
    r"|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3}(?![0-9A-Za-z]|[./:-][0-9]))?)(?![0-9A-Za-z])"
)
ANY = "|".join((EMAIL, SECRET, IBAN, ADDRESS, ADDRESS6, NAMED_DATE, DATE, PHONE, SOCIAL, CARD))

#: First and last code points of the classes a character moves in; each class maps onto itself.
_CLASSES = ((48, 57), (97, 122), (65, 90), (224, 246), (192, 214))
_FIRST_DAY, _DAYS = "1900-01-01", 73049  # to 2099-12-31
_HIGH, _LOW = 271, 270  # the least product of neighbours that covers the days; the rest is walked over


def _stream(key: str, kind: str, other: Column, step: Column, chars: Column | None = None) -> Column:
    """Hexadecimal digits that depend on the key, the kind, the round and the other half: an array of blocks of 64, four
    digits for each of ``chars`` characters, or one block."""
    seed = F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), other)
    last = F.lit(0) if chars is None else F.floor((chars - 1) / 16).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.concat(seed, F.lit("|"), i.cast("string")), 256))


def _moved(char: Column, by: Column, hexadecimal: bool) -> Column:
    if hexadecimal:
        value = F.conv(char, 16, 10).cast("int")
        return F.lower(F.hex(F.pmod(value + by, F.lit(16)).cast("long")))
    code = F.ascii(char)
    out = char
    for low, high in reversed(_CLASSES):
        new = F.chr((F.pmod(code - low + by, F.lit(high - low + 1)) + low).cast("long"))
        if low >= 192:  # chr gives single bytes; these come from their list
            letters = F.lit("".join(map(chr, range(low, high + 1))))
            new = F.substring(letters, F.pmod(code - low + by, F.lit(high - low + 1)).cast("int") + 1, F.lit(1))
        out = F.when(code.between(low, high), new).otherwise(out)
    return out


def _shift(half: Column, stream: Column, hexadecimal: bool) -> Column:
    """Each character of a half moved within its class by four hexadecimal digits of the stream."""

    def one(char, i):
        block = F.get(stream, F.floor(i / 16).cast("int"))
        by = F.conv(F.substring(block, (4 * (i % 16) + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
        return _moved(char, by, hexadecimal)

    return F.array_join(F.transform(F.split(half, ""), one), "")


def permuted(value: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """Keyed permutation of a string of any length; characters of no class stay."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(
        F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, F.length(value)).alias("b")
    )

    def turn(acc, step):
        a, b = acc["a"], acc["b"]
        even = step % 2 == 0
        half, other = F.when(even, b).otherwise(a), F.when(even, a).otherwise(b)
        # the stream is bound once and not made again for every character
        made = F.transform(F.array(_stream(key, kind, other, step, F.length(half))), lambda s: _shift(half, s, hexadecimal))
        moved = F.when(F.length(half) == 0, F.lit("")).otherwise(F.get(made, F.lit(0)))
        return F.struct(F.when(even, a).otherwise(moved).alias("a"), F.when(even, moved).otherwise(b).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(form: Column, digits: Column) -> Column:
    """The form with its digits replaced, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc, c):
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + is_digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum of the card check: every second digit from the right doubled."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    weighted = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(weighted, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    body = permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(F.lit(0) - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return _refilled(value, F.concat(body, check))


def _card_reading(value: Column) -> Column:
    """The part of a found number that is a card: four groups of four without what follows (a security code), else
    all of it; null if the check refuses both."""
    four = F.regexp_extract(value, "^[0-9]{4}(?:[ -][0-9]{4}){3}(?=[ -])", 0)
    valid = lambda v: F.length(_digits(v)).between(13, 19) & (luhn_sum(_digits(v)) % 10 == 0)
    return F.when((four != "") & valid(four), four).when(valid(value), value)


def _remainder97(text: Column) -> Column:
    digits = F.transform(F.split(text, ""), lambda c: F.conv(c, 36, 10))
    return F.aggregate(F.split(F.array_join(digits, ""), ""), F.lit(0), lambda a, d: (a * 10 + d.cast("int")) % 97)


def _iban(value: Column, key: str) -> Column:
    """Country stays; the account number is permuted and gets its check digits."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    account = permuted(F.substring(plain, F.lit(5), F.length(plain)), key, "iban")
    country = F.substring(plain, F.lit(1), F.lit(2))
    check = F.lpad((F.lit(98) - _remainder97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    new = F.concat(country, check, account)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc, c):
        blank = c == " "
        return F.struct(
            F.concat(acc["out"], F.when(blank, c).otherwise(F.substring(new, acc["at"], F.lit(1)))).alias("out"),
            (acc["at"] + (~blank).cast("int")).alias("at"),
        )

    return F.aggregate(F.split(value, ""), start, step, lambda s: s["out"])


def _iban_valid(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    return F.length(plain).between(15, 34) & (_remainder97(turned) == 1)


def _iban_reading(value: Column) -> Column:
    """The longest part of a found account number, all of it or without groups at its end, that the check accepts."""
    groups = F.split(value, " ")
    parts = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, 1, n), " "))
    return F.get(F.filter(parts, _iban_valid), F.lit(0))


def _read(value: Column, reading: Column, change) -> Column:
    """The reading changed and the rest of the value behind it; without a reading the value."""
    rest = F.substring(value, F.length(reading) + 1, F.length(value))
    return F.when(reading.isNull(), value).otherwise(F.concat(change(reading), rest))


def _number(stream: Column, size: int) -> Column:
    return F.conv(F.substring(F.get(stream, F.lit(0)), F.lit(1), F.lit(12)), 16, 10).cast("long") % size


def permuted_number(value: Column, key: str, kind: str, high: int, low: int, size: int) -> Column:
    """Keyed permutation of 0 .. size - 1 by a Feistel network over ``high * low`` values, walked until in range."""

    def network(x):
        start = F.struct(F.floor(x / low).cast("long").alias("a"), (x % low).cast("long").alias("b"))

        def turn(acc, step):
            a = F.when(step % 2 == 0, acc["a"]).otherwise(
                (acc["a"] + _number(_stream(key, kind, acc["b"].cast("string"), step), high)) % high
            )
            b = F.when(step % 2 == 1, acc["b"]).otherwise(
                (acc["b"] + _number(_stream(key, kind, acc["a"].cast("string"), step), low)) % low
            )
            return F.struct(a.alias("a"), b.alias("b"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["a"] * low + s["b"])

    # a walk leaves the range at most once for each value outside it
    walk = F.sequence(F.lit(1), F.lit(high * low - size))
    return F.aggregate(
        walk, network(value.cast("long")), lambda x, _: F.when(x < size, x).otherwise(network(x))
    )


_DATE_FORMS = (
    ("MMMM d, yyyy", rf"^(?:{_MONTHS}) "),
    ("MMM d, yyyy", rf"^(?!May )(?:{_SHORT}) "),
    ("yyyy-MM-dd", r"^[0-9]{4}-"),
    ("dd.MM.yyyy", r"^[0-9]{2}\."),
    ("MM/dd/yyyy", r"^(?:0[0-9]|1[0-2])/"),
    ("dd/MM/yyyy", r"^(?:1[3-9]|[2-9][0-9])/"),
)


def _date(value: Column, key: str) -> Column:
    """Calendar dates from 1900 to 2099 in six forms; anything else stays. With slashes the month comes first unless
    the first number is above 12. A day has one pseudonym in all forms, so one with the day first may look like one with
    the month first."""
    out = value
    for form, start in _DATE_FORMS:
        day = F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit(_FIRST_DAY).cast("date"))
        new = permuted_number(day, key, "date", _HIGH, _LOW, _DAYS)
        text = F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), new.cast("int")), form)
        out = F.when(value.rlike(start), F.when(day.between(0, _DAYS - 1), text).otherwise(value)).otherwise(out)
    return out


def _folded(value: Column, change) -> Column:
    """A change of small letters; a value all in capitals shares its pseudonym, in capitals."""
    new = change(F.lower(value))
    return F.when((value == F.upper(value)) & (value != F.lower(value)), F.upper(new)).otherwise(new)


def _email(value: Column, key: str) -> Column:
    """The part before @ is permuted; the domain stays."""
    return _folded(
        value,
        lambda v: F.concat(
            permuted(F.substring_index(v, "@", 1), key, "email"), F.lit("@"), F.substring_index(v, "@", -1)
        ),
    )


def _secret(value: Column, key: str) -> Column:
    head = F.regexp_extract(value, "^(AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xoxb-)?", 0)
    rest = permuted(F.substring(value, F.length(head) + 1, F.length(value)), key, "secret")
    return F.when(
        value.rlike("^[0-9a-fA-F]+$"), _folded(value, lambda v: permuted(v, key, "secret", hexadecimal=True))
    ).otherwise(F.concat(head, rest))


def _address(value: Column, key: str) -> Column:
    """The four octets as 32 bits, in two halves of 16."""
    parts = F.split(value, r"\.")
    number = reduce(lambda n, i: n * 256 + parts[i].cast("long"), range(1, 4), parts[0].cast("long"))
    half = 1 << 16
    start = F.struct(F.floor(number / half).cast("long").alias("a"), (number % half).alias("b"))

    def turn(acc, step):
        even = step % 2 == 0
        by = _number(_stream(key, "address", F.when(even, acc["a"]).otherwise(acc["b"]).cast("string"), step), half)
        return F.struct(
            F.when(even, acc["a"]).otherwise((acc["a"] + by) % half).alias("a"),
            F.when(even, (acc["b"] + by) % half).otherwise(acc["b"]).alias("b"),
        )

    def octets(s):
        return F.concat_ws(".", *[F.floor(x).cast("long").cast("string") for x in (s["a"] / 256, s["a"] % 256, s["b"] / 256, s["b"] % 256)])

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, octets)


def _address6(value: Column, key: str) -> Column:
    """The hexadecimal digits in order; colons stay where they are."""
    plain = permuted(F.lower(F.replace(value, F.lit(":"), F.lit(""))), key, "address6", hexadecimal=True)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc, c):
        colon = c == ":"
        return F.struct(
            F.concat(acc["out"], F.when(colon, c).otherwise(F.substring(plain, acc["at"], F.lit(1)))).alias("out"),
            (acc["at"] + (~colon).cast("int")).alias("at"),
        )

    new = F.aggregate(F.split(value, ""), start, step, lambda s: s["out"])
    return F.when((value == F.upper(value)) & (value != F.lower(value)), F.upper(new)).otherwise(new)


def _numbers(value: Column, key: str, kind: str) -> Column:
    """Digits after a country code are permuted; code and layout stay."""
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return F.concat(code, _refilled(rest, permuted(_digits(rest), key, kind)))


def pseudonym(value: Column, key: str) -> Column:
    """Pseudonym of one found value; a value that its check refuses stays as it is."""
    digits = _digits(value)
    whole = lambda pattern: value.rlike("^(?:" + pattern + ")$")
    secret = value.rlike("^[0-9a-fA-F]+$") & value.rlike("[a-fA-F]") & value.rlike("[0-9]") & (F.length(value) >= 32)
    return (
        F.when(F.contains(value, F.lit("@")), _email(value, key))
        .when(F.contains(value, F.lit(":")) & whole(ADDRESS6), _address6(value, key))
        .when(secret | value.rlike("^(AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xoxb-)"), _secret(value, key))
        .when(value.rlike("^[A-Z]{2}[0-9]{2}"), _read(value, _iban_reading(value), lambda v: _iban(v, key)))
        .when(whole(ADDRESS), _address(value, key))
        .when(whole(DATE) | whole(NAMED_DATE), _date(value, key))
        .when(whole(PHONE), _numbers(value, key, "phone"))
        .when(whole(SOCIAL), _refilled(value, permuted(digits, key, "social")))
        .when(whole(CARD), _read(value, _card_reading(value), lambda v: _card(v, key)))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of ``docs``, ``text`` with pseudonyms in the place of personal values, and ``n_replaced``.

    Null texts stay null and have nothing replaced, as have empty ones. Every value found in a whole text is looked at,
    repeated ones each time. A column ``n_replaced`` of the input is replaced; all others pass through, whatever
    their names.
    """
    if not key:
        raise ValueError("a key is needed")
    names = [c for c in docs.columns if c != "n_replaced"]
    others = [F.col(f"`{c}`") for c in names if c != text] or [F.lit(0).alias("none")]
    rows = docs.select(F.struct(*others).alias("rest"), F.col(f"`{text}`").alias("text"))
    # a text without digits, @ and known beginnings of keys costs a short search only
    value = F.col("text")
    heads = reduce(lambda a, b: a | b, [F.contains(value, F.lit(h)) for h in ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live_", "xoxb-")])
    may = F.coalesce(value.rlike("[0-9@]|[0-9A-Fa-f]{32}") | heads, F.lit(False))
    safe = F.when(F.contains(value, F.lit(_ESC)), F.replace(value, F.lit(_ESC), F.lit(_KEPT))).otherwise(value)
    marked = F.regexp_replace(safe, f"(?:{ANY})", f"{_MARK}$0{_MARK}")
    rows = settle(rows, parts=F.when(may, F.split(marked, _MARK)))
    # from here on a row holds the text or its parts, and of a part the new value beside the old one
    found = F.size("parts") > 1
    rows = rows.select("rest", F.when(~found | F.col("parts").isNull(), value).alias("text"), F.when(found, F.col("parts")).alias("parts"))
    new = F.transform("parts", lambda x, i: F.struct(x.alias("old"), F.when(i % 2 == 1, pseudonym(x, key)).alias("new")))
    rows = settle(rows.select("rest", "text", new.alias("parts")), parts=F.col("parts"))
    joined = F.array_join(F.transform("parts", lambda p: F.coalesce(p["new"], p["old"])), "")
    joined = F.when(F.contains(joined, F.lit(_KEPT)), F.replace(joined, F.lit(_KEPT), F.lit(_ESC))).otherwise(joined)
    changed = F.size(F.filter("parts", lambda p: p["new"] != p["old"]))
    out = {text: F.when(F.col("parts").isNull(), value).otherwise(joined)}
    columns = [out[c].alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in names]
    return rows.select(*columns, F.coalesce(F.when(F.col("parts").isNotNull(), changed), F.lit(0)).cast("long").alias("n_replaced"))
