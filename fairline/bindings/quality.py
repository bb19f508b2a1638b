"""D family on lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.bindings.aggregates import PAIR_DAY, pair_days
from fairline.bindings.frames import EV, EV_DAY, LI, ev, ev_day, li
from fairline.bindings.registry import query, table
from fairline.operators import quality as D
from fairline.operators import rolling as R
from fairline.operators.clean import BINS

COLS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "flat", "narrow"]
SRC = """f AS (SELECT CAST(l_linenumber AS DOUBLE) AS l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS l_quantity, l_extendedprice, l_discount, l_tax,
  CAST(7 AS DOUBLE) AS flat, 1000 + l_quantity / 10 AS narrow, CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END AS hit, CAST(l_shipdate AS DATE) AS day, l_returnflag, l_linestatus FROM lineitem)"""


def src(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("double").alias("l_linenumber"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_tax", F.lit(7.0).alias("flat"), (1000 + F.col("l_quantity") / 10).alias("narrow"),
        (F.col("l_discount") >= 0.08).cast("int").alias("hit"), F.to_date("l_shipdate").alias("day"), "l_returnflag", "l_linestatus")


def per_column(columns: list[str], template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query("d1_validate_dataset", "check:s value:f passed:i", f"""
WITH {SRC}, a AS (SELECT avg(hit) AS r, count(*) AS n, datediff('day', min(day), max(day)) AS s FROM f)
SELECT 'missing_columns' AS "check", 1 AS value, 0 AS passed UNION ALL SELECT 'rows', n, 1 FROM a UNION ALL SELECT 'target_rate', r, CASE WHEN r BETWEEN 0.02 AND 0.15 THEN 1 ELSE 0 END FROM a
UNION ALL SELECT 'span_days', s, CASE WHEN s >= 30 THEN 1 ELSE 0 END FROM a""")
def _(spark, sf):
    return D.validate_dataset(src(spark, sf), ["hit", "day", "absent"], "hit", "day")


@query("d2_validate_feature_bounds", "feature:s negative:f above_one:f coverage:f low_coverage:i", f"""
WITH {SRC}, g AS (SELECT *, l_tax - 0.02 AS shifted, CASE WHEN hit = 1 THEN l_quantity END AS sparse FROM f)
{per_column(['l_discount', 'shifted', 'l_quantity'], "SELECT '{c}' AS feature, count(*) FILTER ({c} < 0) AS negative, count(*) FILTER ({c} > 1) AS above_one, avg(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END) AS coverage, CASE WHEN count({c}) < 0.5 * count(*) THEN 1 ELSE 0 END AS low_coverage FROM g")}
UNION ALL SELECT 'sparse', 0, 0, avg(CASE WHEN sparse IS NOT NULL THEN 1 ELSE 0 END), CASE WHEN count(sparse) < 0.5 * count(*) THEN 1 ELSE 0 END FROM g""")
def _(spark, sf):
    rows = src(spark, sf).withColumns({"shifted": F.col("l_tax") - 0.02, "sparse": F.when(F.col("hit") == 1, F.col("l_quantity"))})
    return D.validate_feature_bounds(rows, ["l_discount", "shifted", "l_quantity"], ["l_discount", "shifted", "l_quantity", "sparse"])


@query("d3_validate_predictions", "check:s value:f passed:i", """
WITH v AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice / 450000 END AS p FROM orders), a AS (SELECT count(*) - count(p) AS nf, count(*) FILTER (p < 0 OR p > 1) AS oor,
  avg(p) AS m, stddev_samp(p) AS s, count(DISTINCT round(p, 3)) / count(*) AS d FROM v)
SELECT 'not_finite' AS "check", nf AS value, CASE WHEN nf = 0 THEN 1 ELSE 0 END AS passed FROM a UNION ALL SELECT 'out_of_range', oor, CASE WHEN oor = 0 THEN 1 ELSE 0 END FROM a
UNION ALL SELECT 'mean', m, CASE WHEN m BETWEEN 0.01 AND 0.5 THEN 1 ELSE 0 END FROM a UNION ALL SELECT 'std', s, CASE WHEN s >= 0.01 THEN 1 ELSE 0 END FROM a
UNION ALL SELECT 'distinct_share', d, CASE WHEN d >= 0.1 THEN 1 ELSE 0 END FROM a""")
def _(spark, sf):
    p = F.when(F.col("o_orderkey") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 450000)
    return D.validate_predictions(table(spark, sf, "orders").select(p.alias("p")), "p")


PROFILE = f"""WITH {SRC}, s AS ({per_column(COLS, "SELECT '{c}' AS feature, count({c}) AS n, count(DISTINCT {c}) AS nunique, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM f")})
SELECT *, std / abs(mean) AS cv, CASE WHEN nunique <= 1 THEN 'constant' WHEN nunique <= 5 THEN 'nearly_constant' WHEN std / abs(mean) > 0 AND std / abs(mean) < 0.1 THEN 'low_variance'
  ELSE 'varying' END AS variance_class FROM s"""


@query("d4_profile_columns", "feature:s n:l nunique:l mean:f std:g min:f max:f cv:f variance_class:s", PROFILE)
def _(spark, sf):
    return D.profile_columns(src(spark, sf), COLS)


@query("d4_drop_candidates", "feature:s variance_class:s", f"SELECT feature, variance_class FROM ({PROFILE}) WHERE variance_class <> 'varying'")
def _(spark, sf):
    return D.drop_candidates(D.profile_columns(src(spark, sf), COLS))


@query("d5_profile_nulls", "feature:s nulls:l null_share:f", f"""
WITH {SRC} {per_column(COLS, "SELECT '{c}' AS feature, count(*) - count({c}) AS nulls, 1 - count({c}) / count(*) AS null_share FROM f")}""")
def _(spark, sf):
    return D.profile_nulls(src(spark, sf), COLS)


@query("d5_top_values", "feature:s value:s n:l rank:i", f"""
WITH v AS ({per_column(['l_returnflag', 'l_linestatus', 'l_suppkey'], "SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 2")}),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rank FROM v) SELECT * FROM r WHERE rank <= 5""")
def _(spark, sf):
    return D.top_values(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"])


@query("d5_column_report", "feature:s min:f max:f mean:f median:f std:g", f"""
WITH {SRC} {per_column(COLS, "SELECT '{c}' AS feature, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, median({c}) AS median, stddev_samp({c}) AS std FROM f")}""")
def _(spark, sf):
    return D.column_report(src(spark, sf), COLS)


CC = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "narrow"]


@query("d6_correlation_pairs", "feature_a:s feature_b:s r:f", f"""
WITH {SRC}, p AS ({" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM f" for i, a in enumerate(CC) for b in CC[i + 1:])})
SELECT * FROM p WHERE abs(r) > 0.005""")
def _(spark, sf):
    return D.correlation_pairs(src(spark, sf), CC, 0.005)


@query("d7_calendar_counts", "dimension:s value:s n:l", """
SELECT 'day' AS dimension, strftime(o_orderdate, '%Y-%m-%d') AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL
SELECT 'weekday', CAST(dayofweek(o_orderdate) + 1 AS VARCHAR), count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'month', CAST(month(o_orderdate) AS VARCHAR), count(*) FROM orders GROUP BY 2""")
def _(spark, sf):
    return D.calendar_counts(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")), "date")


@query("d8_target_correlations", "feature:s r:f coverage:f abs_r:f", f"""
WITH {SRC}, c AS ({per_column([c for c in CC if c != 'l_discount'], "SELECT '{c}' AS feature, corr({c}, hit) AS r, count({c}) / count(*) AS coverage FROM f")})
SELECT *, abs(r) AS abs_r FROM c WHERE coverage >= 0.5""")
def _(spark, sf):
    return D.target_correlations(src(spark, sf), [c for c in CC if c != "l_discount"], "hit", 0.5)


@query("d9_effect_summary", "feature:s kind:s mean:f second:f third:f", f"""
WITH {SRC} SELECT 'l_tax' AS feature, 'boost' AS kind, avg(l_tax) AS mean, max(l_tax) AS second, avg(CASE WHEN l_tax > 0 THEN 1 ELSE 0 END) AS third FROM f
UNION ALL SELECT 'l_discount', 'index', avg(l_discount), stddev_samp(l_discount), max(l_discount) - min(l_discount) FROM f
UNION ALL SELECT 'hit', 'indicator', avg(hit), min(hit), max(hit) FROM f""")
def _(spark, sf):
    return D.effect_summary(src(spark, sf), ["l_tax"], ["l_discount"], ["hit", "l_extendedprice"])


@query("d10_logic_checks", "check:s value:f passed:i", f"""
WITH {SRC}, g AS (SELECT *, l_quantity * l_tax AS prod, l_tax / (l_discount + 0.01) AS rat FROM f), a AS (SELECT corr(l_quantity, narrow) AS c1, corr(l_discount, hit) AS c2,
  max(prod) - max(l_quantity) * max(l_tax) * 1.1 AS b, count(*) FILTER (rat < 0 OR rat > 100) AS r, count(*) FILTER (l_quantity < -1 OR l_quantity > 5) AS i FROM g)
SELECT 'corr_l_quantity_narrow' AS "check", c1 AS value, CASE WHEN c1 > 0.1 THEN 1 ELSE 0 END AS passed FROM a UNION ALL SELECT 'corr_l_discount_hit', c2, CASE WHEN c2 < -0.1 THEN 1 ELSE 0 END FROM a
UNION ALL SELECT 'bound_prod', b, CASE WHEN b <= 0 THEN 1 ELSE 0 END FROM a UNION ALL SELECT 'range_rat', r, CASE WHEN r = 0 THEN 1 ELSE 0 END FROM a
UNION ALL SELECT 'index_l_quantity', i, CASE WHEN i = 0 THEN 1 ELSE 0 END FROM a""")
def _(spark, sf):
    rows = src(spark, sf).withColumns({"prod": F.col("l_quantity") * F.col("l_tax"), "rat": F.col("l_tax") / (F.col("l_discount") + 0.01)})
    return D.logic_checks(rows, [("l_quantity", "narrow", ">", 0.1), ("l_discount", "hit", "<", -0.1)], [("prod", "l_quantity", "l_tax")], ["rat"], ["l_quantity"])


@query("d11_feature_coverage", "feature_group:s features:l coverage:f available:i", f"""
WITH {SRC}, g AS (SELECT CASE WHEN hit = 1 THEN l_quantity END AS a, CASE WHEN l_linestatus = 'F' THEN l_tax END AS b, CASE WHEN l_linenumber = 9 THEN 1 END AS c FROM f)
SELECT 'pair' AS feature_group, 2 AS features, avg(CASE WHEN coalesce(a, b) IS NOT NULL THEN 1 ELSE 0 END) AS coverage, 1 AS available FROM g
UNION ALL SELECT 'rare', 1, avg(CASE WHEN c IS NOT NULL THEN 1 ELSE 0 END), 0 FROM g UNION ALL SELECT 'absent', 0, 0, 0 FROM (SELECT 1)""")
def _(spark, sf):
    rows = src(spark, sf).select(F.when(F.col("hit") == 1, F.col("l_quantity")).alias("a"), F.when(F.col("l_linestatus") == "F", F.col("l_tax")).alias("b"),
                                 F.when(F.col("l_linenumber") == 9, 1).alias("c"))
    return D.feature_coverage(rows, {"pair": ["a", "b", "nowhere"], "rare": ["c"], "absent": ["nowhere"]})


@query("d12_quartile_lift", "feature:s n:l low_n:l high_n:l low_rate:f high_rate:f lift:f", f"""
WITH {SRC}, q AS ({per_column(['l_quantity', 'l_extendedprice', 'l_tax'], "SELECT '{c}' AS feature, {c} AS v, hit, quantile_cont({c}, 0.25) OVER () AS lo, quantile_cont({c}, 0.75) OVER () AS hi FROM f WHERE {c} <> 0")})
SELECT feature, count(*) AS n, count(*) FILTER (v < lo) AS low_n, count(*) FILTER (v > hi) AS high_n, avg(hit) FILTER (v < lo) AS low_rate, avg(hit) FILTER (v > hi) AS high_rate,
  avg(hit) FILTER (v > hi) - avg(hit) FILTER (v < lo) AS lift FROM q GROUP BY 1""")
def _(spark, sf):
    return D.quartile_lift(src(spark, sf), ["l_quantity", "l_extendedprice", "l_tax"], "hit")


HIST = f"""WITH {LI}, {PAIR_DAY}, h AS (SELECT ent, opp, day, CASE WHEN hr > 0 THEN 1 ELSE 0 END AS hit, count(*) OVER (PARTITION BY ent, opp ORDER BY day
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history FROM pd)"""


def history(spark, sf):
    pairs = R.pair_expanding_lagged(pair_days(spark, sf).withColumn("pa", F.lit(1)), ["ent", "opp"], "day")
    return pairs.select("ent", "opp", "day", (F.col("hr") > 0).cast("int").alias("hit"), F.col("cumulative_pa").alias("history"))


@query("d13_established_vs_new", "history_class:s n:l rate:f mean_history:f", f"""
{HIST} SELECT CASE WHEN history >= 3 THEN 'established' WHEN history > 0 THEN 'some' ELSE 'new' END AS history_class, count(*) AS n, avg(hit) AS rate, avg(history) AS mean_history FROM h GROUP BY 1""")
def _(spark, sf):
    return D.established_vs_new(history(spark, sf), "history", "hit")


@query("d13_top_history", "ent:l opp:l day:d history:l", f"{HIST} SELECT ent, opp, day, history FROM h ORDER BY history DESC, ent, opp, day LIMIT 10")
def _(spark, sf):
    return D.top_history(history(spark, sf), "history", ["ent", "opp", "day"])


@query("d14_binned_rates", "bin:s n:l rate:f", f"""
WITH {EV} SELECT CASE WHEN x > 0 AND x <= 60 THEN '<60' WHEN x > 60 AND x <= 70 THEN '60-70' WHEN x > 70 AND x <= 80 THEN '70-80' WHEN x > 80 AND x <= 90 THEN '80-90'
  WHEN x > 90 AND x <= 120 THEN '>90' END AS bin, count(*) AS n, avg(hit) AS rate FROM ev GROUP BY 1""")
def _(spark, sf):
    return D.binned_rates(ev(spark, sf), "x", "hit", *BINS["test_temperature"])


@query("d14_sigma_outliers", "event_id:l x:f", f"""
WITH {EV} SELECT event_id, x FROM ev WHERE abs(x - (SELECT avg(x) FROM ev)) > 3 * (SELECT stddev_samp(x) FROM ev)""")
def _(spark, sf):
    return D.sigma_outliers(ev(spark, sf), "x")


@query("d15_leak_check", "leaked_rows:l future_leaks:l", f"""
WITH {EV_DAY} SELECT 0 AS leaked_rows, count(*) FILTER (tail > 0) AS future_leaks FROM (SELECT day, sum(hit) OVER (PARTITION BY user_id ORDER BY day
  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - coalesce(sum(CASE WHEN day <= DATE '2024-01-15' THEN hit END) OVER (PARTITION BY user_id ORDER BY day
  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS tail FROM d) WHERE day <= DATE '2024-01-15'""")
def _(spark, sf):
    rows = ev_day(spark, sf)

    def lagged(df):
        return R.rolling_rows_lagged(df, ["user_id"], ["dn"], ["hit"], [])

    def peeking(df):
        from pyspark.sql import Window
        ahead = Window.partitionBy("user_id").orderBy("dn").rowsBetween(1, Window.unboundedFollowing)
        return df.select("user_id", "day", F.coalesce(F.sum("hit").over(ahead), F.lit(0)).alias("later"))

    honest = D.leak_check(lagged, rows, "day", "2024-01-15").agg(F.count(F.lit(1)).alias("n")).scalar()
    return D.leak_check(peeking, rows, "day", "2024-01-15").where("side = 'with_future'").agg(
        F.count(F.lit(1)).alias("future_leaks")).withColumn("leaked_rows", honest)


@query("d16_period_comparison", "season:i feature:s n:l nonzero_share:f nonzero_mean:f nonzero_max:f", f"""
WITH {SRC}, g AS (SELECT *, year(day) AS season FROM f) {per_column(['l_tax', 'l_quantity'], "SELECT season, '{c}' AS feature, count(*) AS n, avg(CASE WHEN coalesce({c}, 0) <> 0 THEN 1 ELSE 0 END) AS nonzero_share, avg(nullif({c}, 0)) AS nonzero_mean, max(nullif({c}, 0)) AS nonzero_max FROM g GROUP BY 1")}""")
def _(spark, sf):
    return D.period_comparison(src(spark, sf).withColumn("season", F.year("day")), "season", ["l_tax", "l_quantity"])
