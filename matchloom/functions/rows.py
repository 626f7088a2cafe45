"""Row helpers that keep costly expressions from being evaluated twice.

Catalyst pushes a filter below the projection that computes its column by repeating the
expression, and infers such a filter (``size(x) > 0``) for every plain explode. That is right for
cheap columns and wrong for parsed text: the parser would run again for each level it is
pushed through. Filters do not move below an outer explode, which these helpers use. The exploded
value is a column of a projection of its own: only there are common subexpressions shared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(
    df: DataFrame, keep: Sequence[str | Column], array: Column | str, name: str, pos: str | None = None
) -> DataFrame:
    """One row per array element, numbered from 0; rows with a null or empty array give none."""
    array = F.col(array) if isinstance(array, str) else array
    at = pos or "_pos"
    staged = df.select(*keep, array.alias("_array"))
    kept = [F.col(c) for c in staged.columns if c != "_array"]
    rows = staged.select(*kept, F.posexplode_outer("_array").alias(at, name)).where(F.col(at).isNotNull())
    return rows if pos else rows.drop(at)


def inline_rows(df: DataFrame, keep: Sequence[str | Column], structs: Column | str) -> DataFrame:
    """One row per struct of the array, its fields as columns."""
    rows = explode_rows(df, keep, structs, "_struct")
    names = [c for c in rows.columns if c != "_struct"]
    return rows.select(*[F.col(c) for c in names], "_struct.*")


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row, whatever is built on them."""
    kept = [F.col(c) for c in df.columns if c not in columns]
    staged = df.select(*kept, *[c.alias(n) for n, c in columns.items()])
    packed = F.array(F.struct(*columns))
    return staged.select(*kept, F.explode_outer(packed).alias("_settled")).select(*kept, "_settled.*")
