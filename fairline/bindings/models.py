"""E family on lineitem (label: returned), one training per query with small models."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.bindings.registry import query, table
from fairline.functions.durable import shared_folder
from fairline.operators import evaluate as V
from fairline.operators import model as M

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "shift"]
SMALL = M.ModelSettings(forest_trees=8, forest_depth=5, boost_rounds=5, boost_depth=3, boost_rate=0.1)
SRC = """m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(l_shipdate AS DATE) AS date, year(l_shipdate) AS season, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  round(l_discount * 4 + l_tax * 3, 2) * 0.9 + 0.01 AS p FROM lineitem)"""


def rows(spark, sf):
    label = (F.col("l_returnflag") == "R").cast("int")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_quantity") > 2, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice", "l_discount", "l_tax",
        F.to_date("l_shipdate").alias("date"), F.year("l_shipdate").alias("season"), label.alias("label"),
        (F.round(F.col("l_discount") * 4 + F.col("l_tax") * 3, 2) * 0.9 + 0.01).alias("p"), (label * 0.7 + F.col("l_tax") * 10).alias("shift"))


CUTS = f"""{SRC}, dc AS (SELECT date, count(*) AS n FROM m GROUP BY 1), cs AS (SELECT date, sum(n) OVER (ORDER BY date) / (SELECT count(*) FROM m) AS s FROM dc),
ct AS (SELECT max(date) FILTER (s <= 0.7) AS a, max(date) FILTER (s <= 0.85) AS b FROM cs)"""


@query("e1_time_split", "date:d split:s n:l", f"""
WITH {CUTS} SELECT date, CASE WHEN date <= a THEN 'train' WHEN date > a + 7 AND date <= b THEN 'validation' WHEN date > b + 7 THEN 'test' END AS split, count(*) AS n FROM m, ct GROUP BY 1, 2""")
def _(spark, sf):
    return V.time_split(rows(spark, sf), "date", gap_days=7).groupBy("date", "split").agg(F.count(F.lit(1)).alias("n"))


@query("e2_stratified_split", "split:s label:i n:l", f"""
WITH {SRC}, b AS (SELECT label, CAST(CAST('0x' || substr(md5('42|' || label || '|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656 AS u FROM m)
SELECT CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS split, label, count(*) AS n FROM b GROUP BY 1, 2""")
def _(spark, sf):
    return V.stratified_split(rows(spark, sf), "label", ["l_orderkey", "l_linenumber", "l_partkey"]).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("e3_season_split", "season:i split:s n:l", f"""
WITH {SRC} SELECT season, CASE WHEN season IN (2000, 2001) THEN 'test' WHEN season = 1999 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM m GROUP BY 1, 2""")
def _(spark, sf):
    return V.season_split(rows(spark, sf), "season", [2000, 2001]).groupBy("season", "split").agg(F.count(F.lit(1)).alias("n"))


@query("e4_quantile_date_split", "split:s n:l first:d last:d", f"""
WITH {SRC}, k AS (SELECT *, datediff('day', DATE '1970-01-01', date) AS dn FROM m), q AS (SELECT quantile_cont(dn, 0.7) AS c FROM k)
SELECT CASE WHEN dn <= c THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(date) AS first, max(date) AS last FROM k, q GROUP BY 1""")
def _(spark, sf):
    return V.quantile_date_split(rows(spark, sf), "date").groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


METRIC_SPEC = ("n:l accuracy:f roc_auc:f precision:f recall:f f1:f baseline_accuracy:f positive_rate:f prediction_rate:f pr_auc:f log_loss:f brier_score:f "
               "lift_at_1:f lift_at_2:f lift_at_3:f")


@query("e9_binary_metrics", METRIC_SPEC, f"""
WITH {SRC}, v AS (SELECT p, label, CASE WHEN p >= 0.35 THEN 1 ELSE 0 END AS y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM m),
a AS (SELECT count(*) AS n, sum(label) AS pos, sum(label * y) AS tp, sum((1 - label) * y) AS fp, sum(CASE WHEN label = 1 THEN r END) AS ranks,
  avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS log_loss, avg((label - p) ** 2) AS brier_score, avg(label) FILTER (p >= 0.1) / avg(label) AS lift_at_1,
  avg(label) FILTER (p >= 0.2) / avg(label) AS lift_at_2, avg(label) FILTER (p >= 0.3) / avg(label) AS lift_at_3 FROM v),
g AS (SELECT p, count(*) AS n, sum(label) AS pos FROM m GROUP BY 1), h AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) / sum(n) OVER (ORDER BY p DESC) AS prec FROM g)
SELECT *, (tp + n - pos - fp) / n AS accuracy, (ranks - pos * (pos + 1) / 2.0) / (CAST(pos AS DOUBLE) * (n - pos)) AS roc_auc, tp / (tp + fp) AS precision, tp / pos AS recall,
  2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos) AS f1, 1 - pos / n AS baseline_accuracy, pos / n AS positive_rate, (tp + fp) / n AS prediction_rate,
  (SELECT sum(pos * prec) / sum(pos) FROM h) AS pr_auc FROM a""")
def _(spark, sf):
    return V.binary_metrics(rows(spark, sf), "p", "label", 0.35)


BINS = f"""{SRC}, cb AS (SELECT CAST(ceil(p * 10) AS BIGINT) AS bin, count(*) AS rows, avg(label) AS accuracy_in_bin, avg(p) AS avg_confidence, count(*) / (SELECT count(*) FROM m) AS prop_in_bin,
  abs(avg(label) - avg(p)) AS calibration_error FROM m WHERE p > 0 AND p <= 1 GROUP BY 1)"""


@query("e10_calibration_bins", "bin:l rows:l accuracy_in_bin:f avg_confidence:f prop_in_bin:f calibration_error:f", f"WITH {BINS} SELECT * FROM cb")
def _(spark, sf):
    return V.calibration_bins(rows(spark, sf), "p", "label")


@query("e10_calibration_error", "ece:f mce:f", f"WITH {BINS} SELECT sum(prop_in_bin * calibration_error) AS ece, max(calibration_error) AS mce FROM cb")
def _(spark, sf):
    return V.calibration_error(rows(spark, sf), "p", "label")


EXPERIMENTS = """ex AS (SELECT 'step' || l_linenumber AS experiment_name, CAST(l_linenumber AS INTEGER) AS step, 15 * l_linenumber AS feature_count, 0.5 + avg(l_discount) * (1 + l_linenumber / 20.0)
  AS roc_auc, max(l_quantity) / 10 + l_linenumber * 3 AS training_time, avg(l_tax) * 10 AS prediction_time FROM lineitem GROUP BY l_linenumber)"""


def experiments(spark, sf):
    k = F.col("l_linenumber")
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.avg("l_discount").alias("d"), F.max("l_quantity").alias("q"), F.avg("l_tax").alias("t")).select(
        F.concat(F.lit("step"), k).alias("experiment_name"), k.alias("step"), (15 * k).alias("feature_count"), (0.5 + F.col("d") * (1 + k / 20.0)).alias("roc_auc"),
        (F.col("q") / 10 + k * 3).alias("training_time"), (F.col("t") * 10).alias("prediction_time"))


@query("e14_experiment_report", "experiment_name:s step_gain:f gain_over_first:f relative_gain:f new_features:l efficiency_ratio:f features_per_second:f roi_score:f impact_rank:l is_best:i", f"""
WITH {EXPERIMENTS}, w AS (SELECT *, roc_auc - lag(roc_auc) OVER (ORDER BY step) AS step_gain, roc_auc - first(roc_auc) OVER (ORDER BY step) AS gain_over_first,
  (roc_auc - first(roc_auc) OVER (ORDER BY step)) / greatest(first(roc_auc) OVER (ORDER BY step), 0.01) * 100 AS relative_gain, feature_count - lag(feature_count) OVER (ORDER BY step) AS new_features,
  roc_auc / greatest(training_time, 1) AS efficiency_ratio, feature_count / greatest(training_time, 1) AS features_per_second FROM ex)
SELECT *, CASE WHEN step_gain IS NOT NULL THEN step_gain / greatest(new_features * 2, 1) * 100 END AS roi_score, CASE WHEN step_gain IS NOT NULL THEN rank() OVER (PARTITION BY step_gain IS NULL
  ORDER BY step_gain DESC, step) END AS impact_rank, CASE WHEN roc_auc = (SELECT max(roc_auc) FROM ex) THEN 1 ELSE 0 END AS is_best FROM w""")
def _(spark, sf):
    return V.experiment_report(experiments(spark, sf))


@query("e15_recommendations", "topic:s advice:s")
def _(spark, sf):
    return V.recommendations(experiments(spark, sf))


def splits(spark, sf):
    split = V.time_split(rows(spark, sf), "date")
    return tuple(split.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test"))


@query("e5_e6_train_models", "model:s " + METRIC_SPEC)
def _(spark, sf):
    train, _, test = splits(spark, sf)
    out = None
    for kind, model in M.train_models(train, FEATURES, "label", settings=SMALL).items():
        scored = V.binary_metrics(M.predict(model, test, FEATURES), "probability_1", "label").withColumn("model", F.lit(kind))
        out = scored if out is None else out.unionByName(scored)
    return out


@query("e7_train_boosted_logloss", "l_orderkey:l l_linenumber:i date:d probability_1:f")
def _(spark, sf):
    train, validation, test = splits(spark, sf)
    model, _ = M.train_boosted_logloss(train, validation, FEATURES, "label", (SMALL,))
    return M.predict(model, test, FEATURES)


@query("e8_fit_isotonic", "l_orderkey:l l_linenumber:i probability_1:f calibrated:f")
def _(spark, sf):
    train, validation, test = splits(spark, sf)
    model = M.train_model("logistic", train, FEATURES, "label", SMALL)
    isotonic = M.fit_isotonic(M.predict(model, validation, FEATURES), "probability_1", "label")
    return M.apply_isotonic(isotonic, M.predict(model, test, FEATURES), "probability_1")


@query("e8_isotonic_regression", "p:f n:l calibrated:f", f"""
WITH {SRC}, g AS (SELECT p, count(*) AS n, sum(label) AS pos FROM m GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY p) AS cn, sum(pos) OVER (ORDER BY p) AS cp FROM g),
a AS (SELECT x.p, l.p AS l, min((r.cp - l.cp + l.pos) / (r.cn - l.cn + l.n)) AS v FROM c x JOIN c l ON l.p <= x.p JOIN c r ON r.p >= x.p GROUP BY 1, 2)
SELECT g.p, any_value(n) AS n, least(greatest(max(v), 0.000001), 0.999999) AS calibrated FROM a JOIN g ON g.p = a.p GROUP BY 1""")
def _(spark, sf):
    """Greatest of the least means over all ranges of scores around a score (min-max formula)."""
    scored = rows(spark, sf)
    points = scored.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return M.apply_isotonic(M.fit_isotonic(scored, "p", "label"), points, "p")


@query("e11_expanding_cv", "metric:s mean:f std:f")
def _(spark, sf):
    return M.cv_summary(M.expanding_cv(rows(spark, sf), "date", FEATURES[:5], "label", folds=3, settings=SMALL))


def dual(spark, sf):
    train, _, test = splits(spark, sf)
    core = M.train_model("logistic", train, FEATURES[:4], "label", SMALL)
    enhanced = M.train_model("boosted", train, FEATURES, "label", SMALL)
    return M.DualModel(core, FEATURES[:4], enhanced, FEATURES), test


@query("e12_score_with_fallback", "l_orderkey:l l_linenumber:i hr_probability:f used_model:s label:i")
def _(spark, sf):
    model, test = dual(spark, sf)
    full = M.score_with_fallback(model, test.drop("label"))
    return full.unionByName(M.score_with_fallback(model, test.drop("label", "shift")), allowMissingColumns=True)


@query("e13_ablation_experiments", "experiment_name:s step:i feature_count:i roc_auc:f log_loss:f")
def _(spark, sf):
    train, _, test = splits(spark, sf)
    return M.ablation_experiments(train, test, [("baseline", FEATURES[:3]), ("plus_tax", FEATURES[3:5]), ("plus_shift", FEATURES[5:])], "label", settings=SMALL)[0]


@query("e16_save_load_model", "l_orderkey:l l_linenumber:i probability_1:f")
def _(spark, sf):
    import uuid
    train, _, test = splits(spark, sf)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    M.save_model(M.train_model("forest", train, FEATURES, "label", SMALL), path, FEATURES)
    model, metadata = M.load_model(spark, path)
    return M.predict(model, test, metadata["features"])


@query("e17_backtest", METRIC_SPEC + " actual_rate:f predicted_rate:f")
def _(spark, sf):
    model, _ = dual(spark, sf)
    return M.backtest(model, rows(spark, sf), "date", "label", "2000-06-01", "2001-06-30")
