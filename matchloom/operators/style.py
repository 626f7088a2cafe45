"""Style profile of a sample document, one projection per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import rules as R
from matchloom import schemas as S
from matchloom.functions import text as X
from matchloom.functions.rows import settle


def section_order(line_text: Column | str) -> Column:
    """Section names in the order in which their headings first appear."""
    c = X.col(line_text)
    found = [
        F.struct(
            F.regexp_instr(c, F.lit(rf"(?im)^(?:{'|'.join(cues)})")).alias("at"),
            F.lit(name).alias("name"),
        )
        for name, _, cues in R.STYLE_HEADINGS
    ]
    hits = F.filter(F.array(*found), lambda x: x["at"] > 0)
    return F.sort_array(hits)["name"]


def merge_section_order(preferred: Column | str, detected: Column | str) -> Column:
    """Ordered distinct union; the default order when both are empty."""
    empty = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce(X.col(preferred), empty), F.coalesce(X.col(detected), empty)))
    default = F.array(*[F.lit(s) for s in R.DEFAULT_SECTION_ORDER])
    only_preferred = F.when(F.size(X.col(detected)) == 0, X.col(preferred))
    # a list given alone is taken as it is, repeats included
    kept = F.coalesce(F.when(F.size(X.col(preferred)) > 0, only_preferred), both)
    return F.when(F.size(kept) > 0, kept).otherwise(default)


def first_bullet(line_text: Column | str) -> Column:
    """Sign of the first bullet line, empty if there is none."""
    return F.regexp_extract(X.col(line_text), rf"(?m)^([{R.BULLETS}])", 1)


def bullet_style(sign: Column | str) -> Column:
    sign = X.col(sign)
    out = F.lit("bullet")
    for symbol, name in R.BULLET_STYLES.items():
        out = F.when(sign == symbol, F.lit(name)).otherwise(out)
    return out


def heading_case_from_counts(upper: Column, title: Column) -> Column:
    total = upper + title
    return (
        F.when(total == 0, "sentence")
        .when(upper / total >= R.UPPER_SHARE, "upper")
        .when(title >= total * R.TITLE_SHARE, "title")
        .otherwise("sentence")
    )


def layout_density(n: Column) -> Column:
    return (
        F.when(n > R.CONDENSED_OVER_LINES, "condensed")
        .when(n < R.SPACIOUS_UNDER_LINES, "spacious")
        .otherwise("balanced")
    )


def font_size(points: Column) -> Column:
    """Half points: small values are points and are doubled, larger ones are cut to whole numbers."""
    return (
        F.when(points <= R.MAX_POINT_SIZE, (points * 2).cast("int"))
        .when(points.isNotNull(), points.cast("int"))
        .otherwise(F.lit(R.DEFAULT_FONT_SIZE))
    )


def style_signals(df: DataFrame, text: str = "text") -> DataFrame:
    """Add what the text itself shows: detected_order, heading_case, bullet_style, layout_density."""
    return (
        settle(df, _lines=X.line_text(text))
        .withColumn("_upper", X.upper_line_count("_lines"))
        .withColumn("_title", X.title_line_count("_lines"))
        .withColumn("_sign", first_bullet("_lines"))
        .withColumn("_n", X.line_count("_lines"))
        .withColumn("detected_order", section_order("_lines"))
        .withColumn("heading_case", heading_case_from_counts(F.col("_upper"), F.col("_title")))
        .withColumn("bullet_style", bullet_style("_sign"))
        .withColumn("layout_density", layout_density(F.col("_n")))
        .drop("_lines", "_upper", "_title", "_sign", "_n")
    )


def build_style_profiles(
    df: DataFrame, text: str = "text", metadata: str | None = "style_metadata", out: str = "profile"
) -> DataFrame:
    """Add the style profile: caller's metadata first, then what the text shows, then defaults."""
    staged = style_signals(df, text)
    if metadata is None:
        staged = staged.withColumn("_m", F.lit(None).cast(S.STYLE_METADATA))
    else:
        staged = staged.withColumn("_m", F.col(metadata).cast(S.STYLE_METADATA))

    def given(name):
        return X.nonempty(F.col(f"_m.{name}"))

    profile = F.struct(
        merge_section_order(F.col("_m.sectionOrder"), F.col("detected_order")).alias("sectionOrder"),
        F.coalesce(given("headingCase"), F.col("heading_case")).alias("headingCase"),
        F.coalesce(given("bulletStyle"), F.col("bullet_style")).alias("bulletStyle"),
        F.coalesce(given("fontFamily"), F.lit(R.DEFAULT_FONT)).alias("fontFamily"),
        font_size(F.col("_m.fontSize")).alias("fontSize"),
        F.coalesce(given("layoutDensity"), F.col("layout_density")).alias("layoutDensity"),
        F.col("_m.includeSectionDividers").alias("includeSectionDividers"),
        given("accentColor").alias("accentColor"),
    )
    return staged.withColumn(out, F.when(F.col(text).isNotNull(), profile).cast(S.STYLE_PROFILE)).drop(
        "_m", "detected_order", "heading_case", "bullet_style", "layout_density"
    )


def package_style(profile: Column | str, sample: Column | str, pointer: Column | str) -> Column:
    """{profile, sample{meta, rawText}, source{s3Key, metadata, documentType}}; null without profile and sample."""
    profile, sample, pointer = X.col(profile), X.col(sample), X.col(pointer)
    packed = F.struct(
        profile.alias("profile"),
        F.when(
            sample.isNotNull(),
            F.struct(sample["meta"].alias("meta"), F.coalesce(sample["rawText"], F.lit("")).alias("rawText")),
        ).alias("sample"),
        F.when(
            pointer.isNotNull(),
            F.struct(
                pointer["s3Key"].alias("s3Key"),
                pointer["metadata"].alias("metadata"),
                pointer["documentType"].alias("documentType"),
            ),
        ).alias("source"),
    )
    return F.when(profile.isNotNull() | sample.isNotNull(), packed)
