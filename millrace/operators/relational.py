"""Thin helpers over DataFrames where the dialect's defaults differ from Spark's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOIN_TYPES = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}


def order_by(df: DataFrame, *keys: str | tuple[str | Column, bool]) -> DataFrame:
    """Sort by keys, each a column or (column, ascending); NULLs last upwards and first downwards."""
    out = []
    for key in keys:
        column, up = key if isinstance(key, tuple) else (key, True)
        column = F.col(column) if isinstance(column, str) else column
        out.append(column.asc_nulls_last() if up else column.desc_nulls_first())
    return df.orderBy(*out)


def limit_offset(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def join(left: DataFrame, right: DataFrame, on: Column | Sequence[str] | None = None, how: str = "inner") -> DataFrame:
    """A join of any of the dialect's kinds; the planner broadcasts a side only below the session's threshold."""
    kind = JOIN_TYPES[how]
    if kind == "cross":
        return left.crossJoin(right)
    return left.join(right, on, kind)


def aggregate(df: DataFrame, by: Sequence[str | Column], **aggregates: Column) -> DataFrame:
    """GROUP BY `by`; without keys one row, for empty input too."""
    named = [c.alias(n) for n, c in aggregates.items()]
    return df.groupBy(*by).agg(*named) if by else df.agg(*named)


def total(column: str | Column) -> Column:
    """SUM as a double, whatever the argument's type."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("double"))


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """Rows of left whose column is NOT IN right's other column, as SQL has it.

    Spark's own plan for NOT IN broadcasts the right side whatever its size.  Here a plain anti
    join finds the rows without a match; one NULL on the right leaves none, and a NULL on
    the left stays only if the right side is empty.
    """
    facts = right.agg(F.count(F.lit(1)).alias("rows_"), F.count(other).alias("known_"))
    rest = left.join(right.select(F.col(other).alias("other_")).where("other_ IS NOT NULL"), left[column] == F.col("other_"), "left_anti")
    kept = (F.col("rows_") == F.col("known_")) & (F.col(column).isNotNull() | (F.col("rows_") == 0))
    return rest.crossJoin(F.broadcast(facts)).where(kept).drop("rows_", "known_")


def index_range(df: DataFrame, column: str, low=None, high=None, low_inclusive: bool = True, high_inclusive: bool = True) -> DataFrame:
    """Rows with `column` in a range; over a table clustered by it Parquet's statistics skip the rest."""
    c = F.col(column)
    if low is not None:
        df = df.filter(c >= low if low_inclusive else c > low)
    if high is not None:
        df = df.filter(c <= high if high_inclusive else c < high)
    return df
