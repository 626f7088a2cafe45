"""Column -> Column text helpers.

Everything here is a built-in expression over the whole text of a row, so it
stays inside whole-stage code generation and never shuffles: a text is cut,
labelled and counted with regular expressions instead of being exploded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import rules as R

_NOT_SPACE = f"[^{R.SPACE}]"
_VOWELS = "aeiouy"
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonempty(c: Column | str) -> Column:
    """The string, or null when it is empty."""
    c = col(c)
    return F.when(c != "", c)


def strip(c: Column | str) -> Column:
    """Remove white space (all of it, not only blanks) from both ends."""
    return F.trim(col(c), F.lit(R.SPACE_CHARS))


def line_text(c: Column | str) -> Column:
    """Stripped, non-blank lines joined by a line feed.

    Any run of white space with a line break in it becomes one line feed; the
    look-behind makes the scan linear on long runs of blanks, the look-ahead passes over all else quickly.
    """
    broken = F.regexp_replace(
        col(c), rf"(?=[{R.SPACE}])(?<![{R.BLANKS}])[{R.BLANKS}]*+[{R.LINE_BREAKS}][{R.SPACE}]*+", "\n"
    )
    return strip(broken)


def to_lines(line_text_col: Column | str) -> Column:
    """Array of lines of a text made by :func:`line_text` (empty array if none)."""
    return F.array_remove(F.split(col(line_text_col), "\n"), "")


def lines(c: Column | str) -> Column:
    return to_lines(line_text(c))


def line_count(line_text_col: Column | str) -> Column:
    c = col(line_text_col)
    return count_char(c, "\n") + F.when(c == "", 0).otherwise(1)


# --- section labelling ----------------------------------------------------

def _heading_groups(headings: list) -> str:
    """One capturing group per rule, in rule order, over the start of a line."""
    rules = [
        (r"[^\n]*" if kind == "contains" else "") + f"({'|'.join(cues)})" for _, kind, cues in headings
    ]
    return "|".join(rules)


def mark_sections(line_text_col: Column | str, headings: list) -> Column:
    """Replace each heading line by U+001E and the cue found in it.

    U+001E is a line break, so it cannot occur inside a line. The alternatives are tried in
    order: an earlier rule wins on a line that fits several. One pass over the text.
    """
    cue = "".join(f"${i + 1}" for i in range(len(headings)))
    pattern = rf"(?im)^(?:{_heading_groups(headings)})[^\n]*\n"
    return F.regexp_replace(F.concat(col(line_text_col), F.lit("\n")), pattern, f"\x1e{cue}\n")


def section_text(marked: Column | str, name: str, headings: list, default: str = "summary") -> Column:
    """All lines of one section, each ended by a line feed. Text before the first heading
    belongs to ``default``."""
    cues = "|".join(c for n, _, cs in headings if n == name for c in cs)
    starts = [rf"\x1e(?:{cues})\n"] if cues else []
    if name == default:
        starts.append(r"\A")
    found = F.regexp_extract_all(col(marked), F.lit(rf"(?i)(?:{'|'.join(starts)})([^\x1e]*)"), F.lit(1))
    text = F.array_join(found, "")
    # a text without lines is one line feed
    return F.when(F.startswith(text, F.lit("\n")), F.substr(text, F.lit(2))).otherwise(text) if name == default else text


def section_lines(marked: Column | str, name: str, headings: list, default: str = "summary") -> Column:
    return ended_lines(section_text(marked, name, headings, default))


def ended_lines(c: Column | str) -> Column:
    """Array of lines of a text in which every line ends with a line feed."""
    return F.regexp_extract_all(col(c), F.lit(r"([^\n]*)\n"), F.lit(1))


# --- words and tokens -----------------------------------------------------

def skill_words(c: Column | str) -> Column:
    """Sorted distinct words that are all upper case or start with a capital."""
    pattern = r"(?<![A-Za-z+#])(?:[A-Z][A-Za-z+#]+|[+#]+[A-Z][A-Z+#]*(?![A-Za-z+#]))"
    return F.sort_array(F.array_distinct(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))))


# Joins several texts into one for a single pass; a noncharacter, so no text holds it.
JOINT = "\uffff"


def joined(texts: Column) -> Column:
    return F.array_join(texts, JOINT)


def token_text(c: Column | str) -> Column:
    """Normalised tokens of a text, one blank between them (and around them).

    Lower case, punctuation and white space to single blanks, then one plural or tense ending
    cut per token. One class finds the places where an ending may start; its letters are tested before the look-behind
    that checks the length.
    """
    plain = F.regexp_replace(F.lower(col(c)), rf"[\p{{Punct}}{R.SPACE}]++", " ")
    t = f"[^ {JOINT}]"
    endings = rf"[ies](?:(?<=i)ng(?<={t}{{5}})|(?<=e)d(?<={t}{{4}})|(?<=e)s(?<={t}{{5}})|(?<=s)(?<={t}{{4}}))(?!{t})"
    return F.regexp_replace(plain, endings, "")


def split_tokens(token_text_col: Column) -> Column:
    """Array of tokens of a :func:`token_text` (repeats kept)."""
    return F.array_remove(F.split(token_text_col, " "), "")


def normalise_token(c: Column | str) -> Column:
    """The ending rules for one token: ``ing`` (length > 4), ``ed`` (> 3), ``es`` (> 4), ``s`` (> 3)."""
    c = col(c)
    n = F.length(c)
    return (
        F.when(c.endswith("ing") & (n > 4), F.left(c, n - 3))
        .when(c.endswith("ed") & (n > 3), F.left(c, n - 2))
        .when(c.endswith("es") & (n > 4), F.left(c, n - 2))
        .when(c.endswith("s") & (n > 3), F.left(c, n - 1))
        .otherwise(c)
    )


def tokens(c: Column | str) -> Column:
    """Distinct normalised tokens of a text; empty array for null or blank text."""
    return F.array_distinct(split_tokens(token_text(F.coalesce(col(c), F.lit("")))))


def count_char(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def count_matches(c: Column, pattern: str) -> Column:
    """Number of matches, by the growth of the text when each match gets one character more.

    ``regexp_count`` would build an array of all matches first.
    """
    return F.length(F.regexp_replace(c, pattern, f"$0{JOINT}")) - F.length(c)


def word_count(c: Column | str) -> Column:
    return count_matches(col(c), f"{_NOT_SPACE}++")


def word_counts(texts: Column) -> Column:
    """Word count of each text of an array; white space is folded in one pass over all of them."""
    folded = F.split(F.regexp_replace(joined(texts), rf"[{R.SPACE}]++", " "), JOINT)

    def count(t):
        return words_in(F.trim(t))

    return F.when(F.size(texts) == 0, F.array().cast("array<int>")).otherwise(F.transform(folded, count))


def folded_words(c: Column | str) -> Column:
    """Lower-cased words of a text, one blank between them: what ``words_in`` and ``syllables_in`` count in."""
    return F.trim(F.regexp_replace(F.lower(col(c)), rf"[{R.SPACE}]++", " "))


def words_in(folded: Column) -> Column:
    return F.when(folded == "", 0).otherwise(count_char(folded, " ") + 1)


def syllables_in(folded: Column) -> Column:
    """A word has one syllable, and one more for each vowel group behind its first, but for a final ``e``."""
    v, k = f"[{_VOWELS}]", f"[^{_VOWELS} ]"
    return words_in(folded) + count_matches(folded, rf"{v}{k}++(?={v}++(?:(?<!e)|(?=[^ ])))")


def syllable_count(c: Column | str) -> Column:
    """Sum over all words of: vowel groups, less a final ``e`` if there is another group, at least 1."""
    return syllables_in(folded_words(c))


def sentence_count(c: Column | str) -> Column:
    return F.greatest(count_char(col(c), "."), F.lit(1))


def grade_from_counts(words: Column, sentences: Column, syllables: Column) -> Column:
    """Flesch-Kincaid grade from counts, with its floor and its value for empty text."""
    grade = 0.39 * (words / sentences) + 11.8 * (syllables / words) - 15.59
    return F.when(words == 0, F.lit(R.EMPTY_TEXT_GRADE)).otherwise(
        F.round(F.greatest(grade, F.lit(R.MIN_GRADE)), 2)
    )


# --- case -----------------------------------------------------------------

def title_case(c: Column | str) -> Column:
    """First letter of every letter run upper, the rest lower."""
    runs = F.regexp_extract_all(col(c), F.lit(f"[{_CASED}]+|[^{_CASED}]+"), F.lit(0))
    return F.array_join(F.transform(runs, capitalise), "")


def capitalise(c: Column | str) -> Column:
    c = col(c)
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def upper_line_count(line_text_col: Column | str) -> Column:
    """Lines of heading length whose letters are all upper case."""
    return F.regexp_count(
        col(line_text_col),
        F.lit(rf"(?m)^(?=[^\n]{{1,{R.HEADING_MAX_CHARS}}}$)(?=[^\n]*\p{{Lu}})[^\n\p{{Ll}}\p{{Lt}}]+$"),
    )


def title_line_count(line_text_col: Column | str) -> Column:
    """Lines of heading length in title case that are not all upper case."""
    other = rf"[^\n{_CASED}]"
    return F.regexp_count(
        col(line_text_col),
        F.lit(
            rf"(?m)^(?=[^\n]{{1,{R.HEADING_MAX_CHARS}}}$)(?=[^\n]*[\p{{Ll}}\p{{Lt}}])"
            rf"{other}*+(?:[\p{{Lu}}\p{{Lt}}]\p{{Ll}}*+(?:{other}++|$))++$"
        ),
    )


# --- escaping and personal data -------------------------------------------

def escape_xml(c: Column | str) -> Column:
    out = col(c)
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def has_email(c: Column | str) -> Column:
    c = col(c)
    return F.contains(c, F.lit("@")) & c.rlike(R.EMAIL_PATTERN)


def has_phone(c: Column | str) -> Column:
    # every match ends like this; the short pattern rejects most texts cheaply
    c = col(c)
    return c.rlike(r"\d{3}[\s-]?\d{4}\b") & c.rlike(R.PHONE_PATTERN)


def redact_patterns(c: Column | str) -> Column:
    """Replace e-mail addresses and phone numbers."""
    no_mail = F.regexp_replace(col(c), R.EMAIL_PATTERN, R.REDACTED)
    return F.regexp_replace(no_mail, R.PHONE_PATTERN, R.REDACTED)


def redact_spans(text: Column | str, spans: Column | str) -> Column:
    """Replace each (begin, end) span by a mark, in order of ``begin``.

    Overlapping spans follow the plain rule: copy from the end of the previous span
    to the begin of the next one, even when the former lies behind the latter.
    """
    text, spans = col(text), col(spans)
    ordered = F.array_sort(spans, lambda a, b: (F.coalesce(a["begin"], F.lit(0)) - F.coalesce(b["begin"], F.lit(0))).cast("int"))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("int").alias("last"))

    def step(acc, span):
        kept = F.substr(text, acc["last"] + 1, F.greatest(span["begin"].cast("int") - acc["last"], F.lit(0)))
        return F.struct(
            F.concat(acc["parts"], F.array(kept, F.lit(R.REDACTED))).alias("parts"),
            span["end"].cast("int").alias("last"),
        )

    def finish(acc):
        return F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["last"] + 1))

    return F.when(
        text.isNull() | (text == "") | spans.isNull() | (F.size(spans) == 0), text
    ).otherwise(F.aggregate(ordered, start, step, finish))
