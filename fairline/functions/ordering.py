"""Order-based results (running totals, ranks, quantiles) that hold for hot groups.

A plain window puts a whole group into one task. Here rows are range-partitioned
on (group, order), so a hot group spreads over many tasks; each task totals its
own slice, the few slice totals are summed in order, and every row adds the
total of the slices before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.columns import unpivot
from fairline.functions.durable import materialise

_SLICE = "_slice"


def running_totals(
    df: DataFrame, groups: list[str], order: list, measures: list[str], slices: int | None = None
) -> DataFrame:
    """Add ``<m>_before`` = total of ``m`` over earlier rows of the group.

    ``order`` holds column names or sort columns and should be total (end with
    a unique key): rows that tie on it stay in one slice.
    """
    spark = df.sparkSession
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(
        df.repartitionByRange(count, *groups, *order).withColumn(_SLICE, F.spark_partition_id())
    )
    keys = [*groups, _SLICE]
    totals = cut.groupBy(*keys).agg(*[F.sum(m).alias(f"_sum_{m}") for m in measures])
    earlier = Window.partitionBy(*groups).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"_sum_{m}").over(earlier), F.lit(0)).alias(f"_off_{m}") for m in measures]
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select(
        "*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_in_{m}") for m in measures]
    )
    joined = local.join(offsets, keys)
    return joined.select(
        *df.columns, *[(F.col(f"_in_{m}") + F.col(f"_off_{m}")).alias(f"{m}_before") for m in measures]
    )


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Rows per distinct value with ``n`` and ``n_before``; ties collapse before any ordering."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, groups, [value], ["n"])


def average_rank(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """Per distinct value its average rank and the group size (columns ``avg_rank``, ``group_n``)."""
    keys = groups or []
    ranked = value_counts(df, keys, value).withColumn(
        "avg_rank", F.col("n_before") + (F.col("n") + 1) / 2
    )
    if not keys:
        size = df.where(F.col(value).isNotNull()).select(F.count(F.lit(1)).alias("group_n"))
        return ranked.withColumn("group_n", size.scalar())
    sizes = ranked.groupBy(*keys).agg(F.sum("n").alias("group_n"))
    return ranked.join(sizes, keys)


def exact_quantiles(df: DataFrame, columns: list[str], fractions: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per (feature, fraction).

    Values are counted, range-sliced and read off at their positions, so no
    task ever holds all distinct values the way ``percentile`` would.
    """
    ranked = value_counts(unpivot(df, columns), ["feature"], "value")
    sizes = ranked.groupBy("feature").agg(F.sum("n").alias("total"))
    wanted = (
        sizes.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
        .withColumn("position", F.col("fraction") * (F.col("total") - 1))
        .withColumn("below", F.floor("position"))
        .withColumn("above", F.ceil("position"))
    )

    def covers(position: str):
        return (F.col("n_before") <= F.col(position)) & (F.col(position) < F.col("n_before") + F.col("n"))

    found = (
        ranked.join(wanted, "feature")
        .where(covers("below") | covers("above"))
        .groupBy("feature", "fraction", "position", "below")
        .agg(
            F.max(F.when(covers("below"), F.col("value"))).alias("lo"),
            F.max(F.when(covers("above"), F.col("value"))).alias("hi"),
        )
    )
    return found.select(
        "feature",
        "fraction",
        (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("position") - F.col("below"))).alias("value"),
    )


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with a column per requested ``name -> (column, fraction)``."""
    columns = sorted({c for c, _ in wanted.values()})
    fractions = sorted({f for _, f in wanted.values()})
    q = exact_quantiles(df, columns, fractions)
    return q.agg(*[
        F.max(F.when((F.col("feature") == c) & (F.col("fraction") == F.lit(float(f))), F.col("value"))).alias(name)
        for name, (c, f) in wanted.items()
    ])


def nearest_positions(df: DataFrame, groups: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Per group the value at index ``floor(n*fraction)`` of the sorted values (no interpolation)."""
    ranked = value_counts(df, groups, value)
    sizes = ranked.groupBy(*groups).agg(F.sum("n").alias("total"))
    joined = ranked.join(sizes, groups)

    def at(fraction: float):
        index = F.least(F.floor(F.col("total") * F.lit(fraction)), F.col("total") - 1)
        return (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))

    return joined.groupBy(*groups).agg(
        *[F.max(F.when(at(f), F.col(value))).alias(name) for name, f in fractions.items()]
    )
