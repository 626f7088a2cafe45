"""Chat formatting with a grammar round trip, in column expressions only.

    conversation = turn*        turn = "<|im_start|>" role "\\n" text "<|im_end|>\\n"

Each turn is rendered as it is and parsed again; if the parser, which knows no more than the grammar, does not give the
turn back, its control strings are escaped: a backslash is put behind the "<" of "<|im_start|>" and "<|im_end|>", one
more if there are some. The parser takes one backslash away again, so escaping is reversible. The loss mask is
a list of spans of the output, one for the text of each assistant turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = r"<(\\*)\|im_(start|end)\|>"
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"<\\$1|im_$2|>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|im_(start|end)\|>", "<$1|im_$2|>")


def _escaped_role(role: Column) -> Column:
    """As a text; line ends and backslashes become letters behind a backslash, for a role ends at its line's end."""
    plain = F.replace(escaped(role), F.lit("\\"), F.lit("\\b"))
    return F.replace(plain, F.lit("\n"), F.lit("\\n"))


def _unescaped_role(role: Column) -> Column:
    lines = F.replace(role, F.lit("\\n"), F.lit("\n"))
    return unescaped(F.replace(lines, F.lit("\\b"), F.lit("\\")))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parse(formatted: Column) -> Column:
    """Turns (``role``, ``text``) of an output, null if it does not follow the grammar."""
    parts = F.split(formatted, F.lit(r"<\|im_end\|>\n"))
    bodies = F.slice(parts, F.lit(1), F.size(parts) - 1)
    inner = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))

    def turn(p):
        role = F.substring_index(inner(p), "\n", 1)
        text = F.substring(p, F.length(role) + len(START) + 2, F.length(p))
        return F.struct(_unescaped_role(role).alias("role"), unescaped(text).alias("text"))

    def sound(p):
        body = inner(p)
        return (
            F.startswith(p, F.lit(START)) & F.contains(body, F.lit("\n"))
            & ~F.contains(body, F.lit(START)) & ~F.contains(body, F.lit(END))
        )

    return F.when((F.element_at(parts, -1) == "") & F.forall(bodies, sound), F.transform(bodies, turn))


def _same(role: Column, text: Column, rendered: Column) -> Column:
    """Whether the parser gives exactly this turn back."""
    found = parse(rendered)
    one = F.get(found, F.lit(0))
    return F.coalesce((F.size(found) == 1) & (one["role"] == role) & (one["text"] == text), F.lit(False))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_mask`` (array of ``start``, ``stop``: code points of
    ``formatted`` from 0, the stop excluded).

    ``turns`` has ``conv_id``, ``turn``, ``role``, ``text``. Turns follow by ``turn`` (null first), repeated numbers by
    role and text; repeated rows stay. Null roles and texts are empty. Rows without a conv_id are one conversation
    with a null id. An empty table gives an empty result. Other columns are not read. A conversation must fit a row.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    plain = render(F.col("role"), F.col("text"))
    safe = render(_escaped_role(F.col("role")), escaped(F.col("text")))
    rows = rows.withColumn("piece", F.when(_same(F.col("role"), F.col("text"), plain), plain).otherwise(safe))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select(
        "conv_id", "role", "piece",
        F.row_number().over(order).alias("at"),
        F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("ends"),
    )
    head = F.length(F.substring_index("piece", "\n", 1)) + 1
    span = F.struct(
        (F.col("ends") - F.length("piece") + head).alias("start"), (F.col("ends") - len(END) - 1).alias("stop")
    )
    learned = F.when(F.col("role") == LEARNED_ROLE, span)
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", learned.alias("span")))).alias("t"))
    spans = F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull())
    return grouped.select(
        "conv_id", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_mask")
    )


def read_back(chats: DataFrame) -> DataFrame:
    """From ``format_chats``: ``conv_id``, ``turns`` by the parser, ``loss_text`` under the mask, ``formatted_chars``."""
    masked = F.transform(
        "loss_mask",
        lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))),
    )
    return chats.select(
        "conv_id", parse(F.col("formatted")).alias("turns"), F.array_join(masked, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
