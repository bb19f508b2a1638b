"""Splits, metrics, calibration error and experiment reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.columns import day_number, first_matching, one_row
from fairline.functions.ordering import running_totals


def cut_dates(df: DataFrame, date: str, shares: list[float]) -> DataFrame:
    """One row of cut dates ``cut_0..``: the last date whose cumulative row share stays within each limit.

    Rows collapse to one per date first; the running window sees the calendar only.
    """
    daily = df.groupBy(F.col(date).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    share = daily.withColumn("_share", F.sum("_n").over(upto) / total)
    return share.agg(F.min("_d").alias("first"), *[
        F.max(F.when(F.col("_share") <= s + 1e-12, F.col("_d"))).alias(f"cut_{i}") for i, s in enumerate(shares)])


def time_split(df: DataFrame, date: str, train: float = 0.7, validation: float = 0.15, gap_days: int = 0) -> DataFrame:
    """Chronological ``split`` column; dates are never divided, rows inside a gap get null."""
    cuts = one_row(cut_dates(df, date, [train, train + validation]))
    first, second, d = F.coalesce(cuts["cut_0"], cuts["first"]), F.coalesce(cuts["cut_1"], cuts["first"]), F.col(date)
    return df.withColumn("split", F.when(d <= first, "train").when((d > F.date_add(first, gap_days)) & (d <= second), "validation").when(
        d > F.date_add(second, gap_days), "test"))


def stratified_split(df: DataFrame, label: str, keys: list[str], train: float = 0.7, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """Random split that any re-run reproduces: a hash of the row key; every class is split by the same shares."""
    text = F.concat_ws("|", F.lit(seed), F.col(label), *[F.col(k) for k in keys])
    bucket = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / 2.0**48
    return df.withColumn("split", F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test"))


def season_split(df: DataFrame, season: str, test_seasons: list[int]) -> DataFrame:
    """Chosen seasons test, the one before them validation, the rest train."""
    s = F.col(season)
    return df.withColumn("split", F.when(s.isin(test_seasons), "test").when(s == min(test_seasons) - 1, "validation").otherwise("train"))


def quantile_date_split(df: DataFrame, date: str, share: float = 0.7) -> DataFrame:
    """Train up to the share quantile of the dates (``percentile`` is safe here: it holds distinct days only)."""
    cut = df.agg(F.percentile(day_number(date), share).alias("cut")).scalar()
    return df.withColumn("split", F.when(day_number(date) <= cut, "train").otherwise("test"))


def expanding_folds(df: DataFrame, date: str, folds: int = 5) -> list[tuple[DataFrame, DataFrame]]:
    """Expanding (train, test) pairs cut between dates."""
    cuts = one_row(cut_dates(df, date, [i / (folds + 1) for i in range(1, folds + 1)]))
    d = F.col(date)
    pairs = []
    for i in range(folds):
        start = F.coalesce(cuts[f"cut_{i}"], cuts["first"])
        later = df.where(d > start)
        test = later.where(d <= cuts[f"cut_{i + 1}"]) if i + 1 < folds else later
        pairs.append((df.where(d <= start), test))
    return pairs


def binary_metrics(df: DataFrame, p: str, label: str, threshold: float = 0.5, lifts: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    """One row of all metrics.

    Rows collapse to distinct scores with counts; running totals over the score
    order (range slices, no global sort in one task) give the exact AUC with
    tied scores at half weight and the average precision.
    """
    scores = df.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    ranked = running_totals(scores, [], ["p"], ["n", "pos"])
    whole = one_row(ranked.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")))
    total, positives = whole["n"], whole["pos"]
    staged = ranked.withColumns({"_total": total, "_positives": positives})
    n, pos, pr = F.col("n"), F.col("pos"), F.col("p")
    neg, neg_before = n - pos, F.col("n_before") - F.col("pos_before")
    tp_from, n_from = F.col("_positives") - F.col("pos_before"), F.col("_total") - F.col("n_before")
    safe = F.least(F.greatest(pr, F.lit(1e-15)), F.lit(1 - 1e-15))
    hit = pr >= threshold

    def when(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(0))

    sums = staged.agg(
        F.max("_total").alias("n"), F.max("_positives").alias("positives"), when(hit, pos).alias("tp"), when(hit, neg).alias("fp"),
        F.sum(pos * (neg_before + neg / 2)).alias("wins"), F.sum(pos * tp_from / n_from).alias("ap"),
        F.sum(-(pos * F.ln(safe) + neg * F.ln(1 - safe))).alias("loss"), F.sum(pos * (1 - pr) * (1 - pr) + neg * pr * pr).alias("squares"),
        *[e.alias(f"{k}_{i}") for i, t in enumerate(lifts) for k, e in (("ln", when(pr >= t, n)), ("lp", when(pr >= t, pos)))],
    )
    c = F.col
    negatives = c("n") - c("positives")
    precision = F.when(c("tp") + c("fp") > 0, c("tp") / (c("tp") + c("fp"))).otherwise(0.0)
    recall = F.when(c("positives") > 0, c("tp") / c("positives")).otherwise(0.0)
    return sums.select(
        "n", ((c("tp") + negatives - c("fp")) / c("n")).alias("accuracy"),
        F.when((c("positives") > 0) & (negatives > 0), c("wins") / (c("positives") * negatives)).alias("roc_auc"),
        precision.alias("precision"), recall.alias("recall"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
        (negatives / c("n")).alias("baseline_accuracy"), (c("positives") / c("n")).alias("positive_rate"),
        ((c("tp") + c("fp")) / c("n")).alias("prediction_rate"), F.when(c("positives") > 0, c("ap") / c("positives")).alias("pr_auc"),
        (c("loss") / c("n")).alias("log_loss"), (c("squares") / c("n")).alias("brier_score"),
        *[F.when(c(f"ln_{i}") > 0, (c(f"lp_{i}") / c(f"ln_{i}")) / (c("positives") / c("n"))).alias(f"lift_at_{int(round(t * 10))}")
          for i, t in enumerate(lifts)],
    )


def calibration_bins(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Per right-closed bin: share of rows, mean label, mean score, their distance."""
    index = F.ceil(F.col(p) * bins)
    inside = df.where((F.col(p) > 0) & (F.col(p) <= 1)).groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(label).alias("accuracy_in_bin"), F.avg(p).alias("avg_confidence"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return inside.withColumns({
        "prop_in_bin": F.col("rows") / total, "calibration_error": F.abs(F.col("accuracy_in_bin") - F.col("avg_confidence"))})


def calibration_error(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Expected and maximum calibration error."""
    return calibration_bins(df, p, label, bins).agg(
        F.sum(F.col("prop_in_bin") * F.col("calibration_error")).alias("ece"), F.max("calibration_error").alias("mce"))


def aggregate_cv(fold_metrics: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population deviation per metric over folds."""
    wide = fold_metrics.agg(*[f(m).alias(f"{n}_{m}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"mean_{m}").alias("mean"), F.col(f"std_{m}").alias("std")) for m in metrics])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def experiment_report(results: DataFrame, step: str = "step", hours_per_feature: float = 2.0) -> DataFrame:
    """Per experiment its gain over the previous step and the first, efficiency, return on effort and ranks.

    One row per experiment goes in, so the unpartitioned order spans a handful of rows.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(step)
    base = F.first("roc_auc").over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag("roc_auc").over(w)
    added = F.col("feature_count") - F.lag("feature_count").over(w)
    staged = results.withColumns({
        "step_gain": F.col("roc_auc") - before, "gain_over_first": F.col("roc_auc") - base,
        "relative_gain": (F.col("roc_auc") - base) / F.greatest(base, F.lit(0.01)) * 100, "new_features": added,
        "efficiency_ratio": F.col("roc_auc") / F.greatest(F.col("training_time"), F.lit(1.0)),
        "features_per_second": F.col("feature_count") / F.greatest(F.col("training_time"), F.lit(1.0)),
    })
    effort = F.greatest(F.col("new_features") * hours_per_feature, F.lit(1.0))
    roi = staged.withColumn("roi_score", F.col("step_gain") / effort * 100)
    return roi.withColumns({
        "impact_rank": F.when(F.col("step_gain").isNotNull(), F.rank().over(Window.partitionBy(F.col("step_gain").isNull()).orderBy(F.desc("step_gain"), step))),
        "is_best": (F.col("roc_auc") == F.max("roc_auc").over(Window.partitionBy(F.lit(0)))).cast("int"),
    })


def recommendations(results: DataFrame, step: str = "step") -> DataFrame:
    """Advice rows from thresholds on the first, best and last experiment."""
    order = F.col(step)
    report = experiment_report(results, step)
    s = report.agg(
        (F.max("roc_auc") - F.min_by("roc_auc", order)).alias("gain"), F.max("step_gain").alias("step_gain"),
        F.max_by("experiment_name", F.coalesce(F.col("step_gain"), F.lit(-1.0))).alias("best_step"), F.count(F.lit(1)).alias("n"),
        F.min_by("training_time", order).alias("first_time"), F.max_by("training_time", order).alias("last_time"),
        F.max_by("feature_count", order).alias("features"), F.max_by("prediction_time", order).alias("predict"), F.max_by("roc_auc", order).alias("auc"))
    c = F.col
    advice = {
        "improvement": first_matching([(c("gain") > 0.05, F.lit("excellent gain: the features are effective")),
                                       (c("gain") > 0.02, F.lit("good gain: refine the strongest features"))], F.lit("small gain: select and rework features")),
        "best_step": F.when((c("n") > 1) & (c("step_gain") > 0.01), F.concat(F.lit("strongest step: "), c("best_step"))),
        "training_time": F.when((c("n") > 2) & (c("last_time") > c("first_time") * 5), F.lit("training time grew: select features")),
        "feature_count": F.when(c("features") > 100, F.lit("many features: consider selection")).when(c("features") < 20, F.lit("few features: more may help")),
        "prediction_time": F.when(c("predict") > 1.0, F.lit("prediction is slow")).otherwise(F.lit("prediction time is fine")),
        "readiness": first_matching([(c("auc") > 0.65, F.lit("ready for use with risk limits")), (c("auc") > 0.55, F.lit("usable, more features may help"))],
                                    F.lit("needs better data or features")),
    }
    rows = F.array(*[F.struct(F.lit(t).alias("topic"), m.alias("advice")) for t, m in advice.items()])
    return s.select(F.explode(rows).alias("r")).select("r.*").where(F.col("advice").isNotNull())
