"""Validation, profiling and analysis of tables and features (D family).

Per-column statistics are computed in one pass as wide aggregates and turned
into rows afterwards; nothing is unpivoted at row grain unless distinct values
are needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.columns import first_matching, one_row, unpivot
from fairline.functions.ordering import exact_quantiles, quantile_row
from fairline.operators.clean import bin_column

Stat = Callable[[Column], Column]


def long_stats(df: DataFrame, columns: list[str], stats: dict[str, Stat], groups: list[str] | None = None) -> DataFrame:
    """One row per column (and group) with the given statistics, all as double."""
    keys = groups or []
    wide = df.groupBy(*keys).agg(*[
        fn(F.col(c)).cast("double").alias(f"_{i}_{name}") for i, c in enumerate(columns) for name, fn in stats.items()])
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"_{i}_{name}").alias(name) for name in stats]) for i, c in enumerate(columns)])
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def checks(df: DataFrame, values: dict[str, Column], passed: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows (check, value, passed) from one aggregate."""
    wide = df.agg(*[c.cast("double").alias(n) for n, c in values.items()])
    rows = F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(n).alias("value"), F.coalesce(passed[n](F.col(n)), F.lit(False)).cast("int").alias("passed"))
        for n in values])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def validate_dataset(df: DataFrame, required: list[str], target: str, date: str) -> DataFrame:
    """Required columns, rows, target rate within 2-15 %, span of at least 30 days."""
    missing = len([c for c in required if c not in df.columns])
    return checks(df, {
        "missing_columns": F.coalesce(F.max(F.lit(missing)), F.lit(missing)), "rows": F.count(F.lit(1)), "target_rate": F.avg(target),
        "span_days": F.datediff(F.max(date), F.min(date)),
    }, {
        "missing_columns": lambda v: v == 0, "rows": lambda v: v > 0, "target_rate": lambda v: v.between(0.02, 0.15),
        "span_days": lambda v: v >= 30,
    })


def validate_feature_bounds(df: DataFrame, rates: list[str], features: list[str], minimum: float = 0.5) -> DataFrame:
    """Rows below 0 and above 1 of rate columns, coverage of every feature."""
    out = long_stats(df, features, {
        "negative": lambda c: F.sum((c < 0).cast("int")), "above_one": lambda c: F.sum((c > 1).cast("int")),
        "coverage": lambda c: F.avg(c.isNotNull().cast("int")),
    })
    is_rate = F.col("feature").isin(rates)
    return out.select(
        "feature", F.when(is_rate, F.coalesce("negative", F.lit(0.0))).otherwise(0.0).alias("negative"),
        F.when(is_rate, F.coalesce("above_one", F.lit(0.0))).otherwise(0.0).alias("above_one"), "coverage",
        (F.col("coverage") < minimum).cast("int").alias("low_coverage"))


def validate_predictions(df: DataFrame, p: str) -> DataFrame:
    """D3: finite, within [0, 1], mean 0.01-0.5, deviation at least 0.01, at least 10 % distinct at three decimals."""
    v = F.col(p).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    distinct = df.where(finite).groupBy(F.round(v, 3).alias("r")).agg(F.count(F.lit(1)).alias("k")).agg(
        F.count(F.lit(1)).alias("d")).scalar()
    n = F.count(F.lit(1))
    return checks(df, {
        "not_finite": F.sum((~finite).cast("int")), "out_of_range": F.sum((finite & ((v < 0) | (v > 1))).cast("int")),
        "mean": F.avg(F.when(finite, v)), "std": F.stddev(F.when(finite, v)), "distinct_share": F.max(distinct) / n,
    }, {
        "not_finite": lambda x: x == 0, "out_of_range": lambda x: x == 0, "mean": lambda x: x.between(0.01, 0.5),
        "std": lambda x: x >= 0.01, "distinct_share": lambda x: x >= 0.1,
    })


def distinct_values(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column; exact counts go through (column, value) groups, spread over all tasks."""
    if approximate:
        return long_stats(df, columns, {"nunique": F.approx_count_distinct})
    pairs = unpivot(df, columns).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("k"))
    return pairs.groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("nunique"))


def profile_columns(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Count, distinct values, mean, deviation, extremes, coefficient of variation and variance class."""
    stats = long_stats(df, columns, {
        "n": F.count, "mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max})
    joined = stats.join(distinct_values(df, columns, approximate), "feature", "left").withColumn("nunique", F.coalesce("nunique", F.lit(0.0)))
    cv = F.when(F.col("mean") != 0, F.col("std") / F.abs("mean"))
    out = joined.withColumn("cv", cv)
    return out.withColumn("variance_class", first_matching([
        (F.col("nunique") <= 1, F.lit("constant")), (F.col("nunique") <= 5, F.lit("nearly_constant")),
        ((F.col("cv") > 0) & (F.col("cv") < 0.1), F.lit("low_variance"))], F.lit("varying")))


def drop_candidates(profile: DataFrame, keep: tuple[str, ...] = ("varying",)) -> DataFrame:
    """P15 input: features whose variance class calls for dropping."""
    return profile.where(~F.col("variance_class").isin(*keep)).select("feature", "variance_class")


def profile_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count and share per column."""
    return long_stats(df, columns, {
        "nulls": lambda c: F.sum(c.isNull().cast("int")), "null_share": lambda c: F.avg(c.isNull().cast("int"))})


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The most frequent values per column (as text)."""
    wide = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = wide.unpivot([], columns, "feature", "value").where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Extremes, mean, median and deviation per numeric column."""
    medians = exact_quantiles(df, columns, [0.5]).select("feature", F.col("value").alias("median"))
    return long_stats(df, columns, {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev}).join(medians, "feature", "left")


def _gram(columns: list[str], means: list[float]):
    """Joint counts, sums, squares and products of all column pairs of a task's rows, kept as matrices."""
    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(columns)
        n, s, q, p = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = batch.to_numpy(dtype=np.float64) - np.array(means)
            known = ~np.isnan(x)
            x, f = np.where(known, x, 0.0), known.astype(np.float64)
            n += f.T @ f
            s += x.T @ f
            q += (x * x).T @ f
            p += x.T @ x
        i, j = np.triu_indices(k, 1)
        there = n[i, j] > 0
        i, j = i[there], j[there]
        yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "si": s[i, j], "sj": s[j, i], "qi": q[i, j], "qj": q[j, i], "p": p[i, j]})

    return add_up


def correlation_pairs(df: DataFrame, columns: list[str], threshold: float = 0.7) -> DataFrame:
    """Pearson correlation of column pairs above a threshold, from one pass whatever the number of columns.

    Each pair uses the rows that have both values (null and NaN are missing), whatever the other columns hold. A task
    keeps four matrices of columns x columns and sends one row for each pair; values are taken from their column's mean
    first, so sums of squares don't cancel. A column that doesn't vary among a pair's rows correlates with nothing.
    """
    if len(columns) < 2:
        raise ValueError("correlation needs two columns")
    wide = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    # one value for each column
    averages = wide.agg(*[F.avg(c).alias(c) for c in columns]).first()
    means = [averages[c] or 0.0 for c in columns]
    sums = ["n", "si", "sj", "qi", "qj", "p"]
    parts = wide.mapInPandas(_gram(columns, means), "i int, j int, " + ", ".join(f"{c} double" for c in sums))
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums])
    names, sizes = F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(abs(m)) for m in means])
    c = F.col

    def spread(side: str, index: str) -> Column:
        value = (c(f"q{side}") - c(f"s{side}") * c(f"s{side}") / c("n")) / c("n")
        return F.when(value > F.pow(F.get(sizes, c(index)) * 1e-12, F.lit(2)), value)

    r = (c("p") - c("si") * c("sj") / c("n")) / c("n") / F.sqrt(spread("i", "i") * spread("j", "j"))
    pairs = total.select(F.get(names, c("i")).alias("feature_a"), F.get(names, c("j")).alias("feature_b"), F.when(c("n") > 1, r).alias("r"))
    return pairs.where(F.abs("r") > threshold)


def calendar_counts(df: DataFrame, date: str) -> DataFrame:
    """Rows per day, weekday (1 = Sunday) and month."""
    parts = {"day": F.date_format(date, "yyyy-MM-dd"), "weekday": F.dayofweek(date).cast("string"), "month": F.month(date).cast("string")}
    daily = df.groupBy(F.to_date(date).alias(date)).agg(F.count(F.lit(1)).alias("k"))
    long = daily.select("k", F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("value")) for n, c in parts.items()])).alias("d"))
    return long.select("k", "d.*").groupBy("dimension", "value").agg(F.sum("k").alias("n"))


def target_correlations(df: DataFrame, features: list[str], target: str, minimum_coverage: float = 0.0) -> DataFrame:
    """Correlation of every feature with the target, enough coverage only; order by ``abs_r`` where read."""
    out = long_stats(df, features, {"r": lambda c: F.corr(c, F.col(target)), "coverage": lambda c: F.avg(c.isNotNull().cast("int"))})
    return out.where(F.col("r").isNotNull() & ~F.isnan("r") & (F.col("coverage") >= minimum_coverage)).withColumn("abs_r", F.abs("r"))


def effect_summary(df: DataFrame, boosts: list[str], indices: list[str], indicators: list[str]) -> DataFrame:
    """Mean, maximum and positive share of boosts; mean, deviation and range of indices; activation of flags with at most 10 values."""
    boost = long_stats(df, boosts, {
        "mean": F.avg, "second": F.max, "third": lambda c: F.avg((c > 0).cast("int"))}).withColumn("kind", F.lit("boost"))
    index = long_stats(df, indices, {
        "mean": F.avg, "second": F.stddev, "third": lambda c: F.max(c) - F.min(c)}).withColumn("kind", F.lit("index"))
    few = distinct_values(df, indicators).where(F.col("nunique") <= 10)
    flags = long_stats(df, indicators, {"mean": F.avg, "second": F.min, "third": F.max}).join(few.select("feature"), "feature").withColumn("kind", F.lit("indicator"))
    return boost.unionByName(index).unionByName(flags)


def logic_checks(
    df: DataFrame, correlations: list[tuple[str, str, str, float]], products: list[tuple[str, str, str]], ratios: list[str], indices: list[str],
) -> DataFrame:
    """Correlation limits ``(a, b, '>'|'<', limit)``, products below 1.1 x the product of maxima, ratios in [0, 100], indices in [-1, 5]."""
    values, passed = {}, {}
    for a, b, sign, limit in correlations:
        values[f"corr_{a}_{b}"] = F.corr(a, b)
        passed[f"corr_{a}_{b}"] = (lambda v, s=sign, x=limit: v > x if s == ">" else v < x)
    for name, a, b in products:
        values[f"bound_{name}"] = F.max(name) - F.max(a) * F.max(b) * 1.1
        passed[f"bound_{name}"] = lambda v: v <= 0
    for r in ratios:
        values[f"range_{r}"] = F.sum((~F.col(r).between(0, 100)).cast("int"))
        passed[f"range_{r}"] = lambda v: v == 0
    for i in indices:
        values[f"index_{i}"] = F.sum((~F.col(i).between(-1, 5)).cast("int"))
        passed[f"index_{i}"] = lambda v: v == 0
    return checks(df, values, passed)


def feature_coverage(df: DataFrame, groups: dict[str, list[str]], threshold: float = 0.1) -> DataFrame:
    """Share of rows with any feature of a group present; groups meet the threshold or not."""
    present = {g: [c for c in cols if c in df.columns] for g, cols in groups.items()}

    def share(cols: list[str]) -> Column:
        return F.avg(F.coalesce(*[F.col(c).cast("double") for c in cols]).isNotNull().cast("int")) if cols else F.avg(F.lit(0))

    wide = df.agg(*[share(cols).cast("double").alias(g) for g, cols in present.items()])
    rows = F.array(*[F.struct(F.lit(g).alias("feature_group"), F.lit(len(c)).alias("features"), F.col(g).alias("coverage")) for g, c in present.items()])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*").withColumn("available", (F.col("coverage") >= threshold).cast("int"))


def quartile_lift(df: DataFrame, features: list[str], target: str, minimum_rows: int = 100, minimum_group: int = 10) -> DataFrame:
    """Target rate below the first against above the third quartile of the non-zero values of each feature."""
    nonzero = df.select(target, *[F.nullif(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    q = one_row(quantile_row(nonzero, {f"{side}_{c}": (c, f) for c in features for side, f in (("lo", 0.25), ("hi", 0.75))}))
    tagged = nonzero.select(target, *features, *[q[f"{s}_{c}"].alias(f"_{s}_{c}") for c in features for s in ("lo", "hi")])
    t = F.col(target)
    wide = tagged.agg(*[e.cast("double").alias(n) for c in features for n, e in {
        f"n_{c}": F.count(c), f"ln_{c}": F.sum((F.col(c) < F.col(f"_lo_{c}")).cast("int")), f"hn_{c}": F.sum((F.col(c) > F.col(f"_hi_{c}")).cast("int")),
        f"lr_{c}": F.avg(F.when(F.col(c) < F.col(f"_lo_{c}"), t)), f"hr_{c}": F.avg(F.when(F.col(c) > F.col(f"_hi_{c}"), t))}.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"ln_{c}").alias("low_n"), F.col(f"hn_{c}").alias("high_n"),
                              F.col(f"lr_{c}").alias("low_rate"), F.col(f"hr_{c}").alias("high_rate")) for c in features])
    long = wide.select(F.explode(rows).alias("_r")).select("_r.*")
    return long.where((F.col("n") > minimum_rows) & (F.col("low_n") > minimum_group) & (F.col("high_n") > minimum_group)).withColumn(
        "lift", F.col("high_rate") - F.col("low_rate"))


def established_vs_new(df: DataFrame, history: str, target: str, minimum: int = 3) -> DataFrame:
    """Rows with at least ``minimum`` earlier meetings, with fewer, and with none: counts and target rate."""
    group = first_matching([(F.col(history) >= minimum, F.lit("established")), (F.col(history) > 0, F.lit("some"))], F.lit("new"))
    return df.groupBy(group.alias("history_class")).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("rate"), F.avg(history).alias("mean_history"))


def top_history(df: DataFrame, history: str, keys: list[str], k: int = 10) -> DataFrame:
    """The ``k`` rows with the longest history."""
    return df.orderBy(F.desc(history), *keys).limit(k)


def binned_rates(df: DataFrame, column: str, target: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Rows and target rate per right-closed bin."""
    return df.groupBy(bin_column(F.col(column), edges, labels).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("rate"))


def sigma_outliers(df: DataFrame, column: str, sigmas: float = 3.0) -> DataFrame:
    """Rows beyond a number of deviations from the mean."""
    s = one_row(df.agg(F.avg(column).alias("mean"), F.stddev(column).alias("std")))
    return df.where(F.abs(F.col(column) - s["mean"]) > s["std"] * sigmas)


def leak_check(build: Callable[[DataFrame], DataFrame], events: DataFrame, day: str, cutoff: str) -> DataFrame:
    """Feature rows up to a day that change when later events are removed; empty if nothing leaks."""
    last = F.lit(cutoff).cast("date")
    full = build(events).where(F.col(day) <= last)
    cut = build(events.where(F.col(day) <= last)).where(F.col(day) <= last)
    return full.exceptAll(cut).withColumn("side", F.lit("with_future")).unionByName(
        cut.exceptAll(full).withColumn("side", F.lit("without_future")))


def period_comparison(df: DataFrame, period: str, features: list[str]) -> DataFrame:
    """Per period and feature: rows, share of non-zero values, their mean and maximum."""
    return long_stats(df, features, {
        "n": lambda c: F.count(F.lit(1)), "nonzero_share": lambda c: F.avg((F.coalesce(c, F.lit(0)) != 0).cast("int")),
        "nonzero_mean": lambda c: F.avg(F.when(c != 0, c)), "nonzero_max": lambda c: F.max(F.when(c != 0, c))}, [period])
