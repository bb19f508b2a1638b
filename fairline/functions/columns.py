"""Column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def day_number(column: Column | str) -> Column:
    """Days since 1970-01-01, the numeric order key range frames need."""
    return F.unix_date(F.to_date(column))


def clip(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a column; null stays null (``greatest`` alone would return the bound)."""
    out = column
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(column.isNotNull(), out)


def ratio(top: Column, bottom: Column, default: float | None = None) -> Column:
    out = F.when(bottom != 0, top / bottom)
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def flag(condition: Column) -> Column:
    """1/0 with null counted as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def or_else(column: Column | str, default) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(default))


def first_matching(pairs: list[tuple[Column, object]], default=None) -> Column:
    """``when`` chain from (condition, value) pairs."""
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default) if default is not None else out


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def one_row(stats: DataFrame, cut: bool = False) -> Column:
    """A one-row aggregate as a scalar subquery; read its fields with ``[name]``.

    Spark runs the aggregate once and inlines one row, so no join is planned.
    Every use carries the aggregate's plan through the optimiser: ``cut`` writes
    the row first, for statistics that many columns read.
    """
    from fairline.functions.durable import materialise

    return (materialise(stats) if cut else stats).select(F.struct("*")).scalar()


def unpivot(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Long form (feature, value) of numeric columns, all as double."""
    kept = keep or []
    wide = df.select(*kept, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(kept, columns, "feature", "value")
