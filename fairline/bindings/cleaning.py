"""P family on events, lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.bindings.frames import EV, EV_DAY, LI, ev, ev_day, li
from fairline.bindings.registry import query, table
from fairline.functions.windows import all_before
from fairline.operators import clean


@query("p1_derive_event_flags", "event_id:l is_pa:i is_hr:i bat_team:s date:d season:i", """
SELECT event_id, CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END AS is_pa,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_hr,
  CASE WHEN hour(ts) < 12 THEN 'A' || user_id ELSE 'H' || user_id END AS bat_team, CAST(ts AS DATE) AS date,
  CASE WHEN month(ts) <= 2 THEN year(ts) - 1 ELSE year(ts) END AS season FROM events""")
def _(spark, sf):
    raw = table(spark, sf, "events").select(
        "event_id", "ts", F.when(F.col("event_type") != "view", F.col("event_type")).alias("events"),
        F.when(F.hour("ts") < 12, "Top").otherwise("Bot").alias("inning_topbot"),
        F.concat(F.lit("H"), "user_id").alias("home_team"), F.concat(F.lit("A"), "user_id").alias("away_team"))
    return clean.derive_event_flags(raw, hit_value="purchase", time="ts")


@query("p2_filter_regular_season", "ent:l n:l", """
SELECT l_suppkey AS ent, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def _(spark, sf):
    rows = clean.filter_regular_season(table(spark, sf, "lineitem"), "l_returnflag", "R")
    return rows.groupBy(F.col("l_suppkey").alias("ent")).agg(F.count(F.lit(1)).alias("n"))


@query("p3_normalise_dates", "o_orderkey:l date:d", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus <> 'P'""")
def _(spark, sf):
    text = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "not a date")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("game_date"))
    return clean.normalise_dates(text)


@query("p4_season_calendar", "o_orderkey:l season:i legacy:i valid:i from_day:d to_day:d", """
SELECT o_orderkey, CASE WHEN month(o_orderdate) <= 2 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END AS season,
  CASE WHEN month(o_orderdate) IN (1, 2, 11, 12) THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END AS legacy,
  CASE WHEN month(o_orderdate) BETWEEN 3 AND 10 THEN 1 ELSE 0 END AS valid,
  CAST(o_orderdate AS DATE) - 45 AS from_day, CAST(o_orderdate AS DATE) AS to_day FROM orders""")
def _(spark, sf):
    d = F.to_date("o_orderdate")
    lo, hi = clean.lookback_range(d, 45)
    return table(spark, sf, "orders").select(
        "o_orderkey", clean.season_of(d).alias("season"), clean.season_of(d, legacy=True).alias("legacy"),
        clean.is_valid_game_date(d).cast("int").alias("valid"), lo.alias("from_day"), hi.alias("to_day"))


@query("p5_require_columns", "user_id:l n:l", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    rows = clean.require_columns(table(spark, sf, "events"), ["user_id", "ts", "event_type"])
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("p6_impute_median", "event_id:l x:f angle:f", f"""
WITH {EV}, raw AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN x END AS x,
  CASE WHEN event_type <> 'error' THEN angle END AS angle FROM ev)
SELECT event_id, coalesce(x, (SELECT quantile_cont(x, 0.5) FROM raw)) AS x,
  coalesce(angle, (SELECT quantile_cont(angle, 0.5) FROM raw)) AS angle FROM raw""")
def _(spark, sf):
    raw = ev(spark, sf).select(
        "event_id", F.when(F.col("event_type") != "view", F.col("x")).otherwise(float("nan")).alias("x"),
        F.when(F.col("event_type") != "error", F.col("angle")).alias("angle"))
    return clean.impute_median(raw, exclude=("event_id",))


@query("p7_winsorise", "event_id:l x:f", """
WITH q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)
SELECT event_id, least(greatest(value, lo), hi) AS x FROM events, q""")
def _(spark, sf):
    return clean.winsorise(ev(spark, sf).select("event_id", "x"), "x")


@query("p8_clip_rate_columns", "user_id:l day:d hr_rate:f p_rate:f", f"""
WITH {EV_DAY} SELECT user_id, day, least(hit / n, 0.25) AS hr_rate, least(hit / n, 0.15) AS p_rate FROM d""")
def _(spark, sf):
    rates = ev_day(spark, sf).select("user_id", "day", (F.col("hit") / F.col("n")).alias("hr_rate"),
                                     (F.col("hit") / F.col("n")).alias("p_rate"))
    return clean.clip_rate_columns(clean.clip_rate_columns(rates, ["hr_rate"]), ["p_rate"], high=0.15)


@query("p9_map_dimension", "s_suppkey:l stadium:s park_factor:f", """
SELECT s_suppkey, coalesce(n_name, 'none') AS stadium,
  coalesce(CASE WHEN n_regionkey <> 2 THEN 1 + n_regionkey / 10.0 END, 1.0) AS park_factor
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def _(spark, sf):
    dimension = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("stadium"),
        F.when(F.col("n_regionkey") != 2, 1 + F.col("n_regionkey") / 10.0).alias("park_factor"))
    return clean.map_dimension(table(spark, sf, "supplier"), dimension, "s_nationkey",
                               {"stadium": "none", "park_factor": 1.0})


@query("p10_derive_opponent", "l_orderkey:l opp_team:l n:l", """
SELECT l_orderkey, CASE WHEN (CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey ELSE l_partkey END) = l_suppkey
  THEN l_partkey ELSE l_suppkey END AS opp_team, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_partkey",
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("side"))
    return (clean.derive_opponent(rows, "l_suppkey", "l_partkey", "side")
            .groupBy("l_orderkey", "opp_team").agg(F.count(F.lit(1)).alias("n")))


@query("p11_select_available", "p_partkey:l p_size:i", "SELECT p_partkey, p_size FROM part")
def _(spark, sf):
    return clean.select_available(table(spark, sf, "part"), ["p_partkey", "p_weight", "p_size", "p_height"])


@query("p12_standardise_name", "p_partkey:l name:s", r"""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 2 = 0
  THEN p_brand || ' ' || p_name ELSE p_name || ' ' || p_brand END AS name FROM part""")
def _(spark, sf):
    raw = F.when(F.col("p_size") % 5 == 0, F.lit(None).cast("string")).when(
        F.col("p_size") % 2 == 0, F.concat(F.lit("  "), "p_name", F.lit(" , "), "p_brand", F.lit(" "))
    ).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "), "p_brand", F.lit(" ")))
    return table(spark, sf, "part").select("p_partkey", clean.standardise_name(raw).alias("name"))


@query("p13_fill_prediction_defaults", "event_id:l batting_avg:f era:f x:f hits:f slugging_pct:f", f"""
WITH {EV}, raw AS (SELECT event_id, CASE WHEN event_type = 'view' THEN x / 100 END AS batting_avg,
  CASE WHEN event_type <> 'click' THEN x END AS x, CASE WHEN angle > 50 THEN angle END AS hits FROM ev)
SELECT event_id, coalesce(batting_avg, 0.25) AS batting_avg, 4.5 AS era,
  coalesce(x, (SELECT median(x) FROM raw)) AS x, coalesce(hits, 0) AS hits, 0.4 AS slugging_pct FROM raw""")
def _(spark, sf):
    raw = ev(spark, sf).select(
        "event_id", F.when(F.col("event_type") == "view", F.col("x") / 100).alias("batting_avg"),
        F.when(F.col("event_type") != "click", F.col("x")).alias("x"),
        F.when(F.col("angle") > 50, F.col("angle")).alias("hits"))
    return clean.fill_prediction_defaults(raw, clean.LEAGUE_DEFAULTS, ["x"], ["hits"])


@query("p14_align_features", "event_id:l angle:f missing_feature:f x:f", f"""
WITH {EV} SELECT event_id, coalesce(angle, 0) AS angle, 0.0 AS missing_feature,
  coalesce(CASE WHEN event_type <> 'view' THEN x END, 0) AS x FROM ev""")
def _(spark, sf):
    raw = ev(spark, sf).select("event_id", "angle", F.when(F.col("event_type") != "view", F.col("x")).alias("x"))
    return clean.align_features(raw, ["angle", "missing_feature", "x"], ["event_id"], minimum=2)


@query("p15_drop_feature_list", "p_partkey:l p_size:i existed:l missing:l",
       "SELECT p_partkey, p_size, 2 AS existed, 1 AS missing FROM part")
def _(spark, sf):
    kept, existed, missing = clean.drop_feature_list(table(spark, sf, "part"), ["p_name", "p_brand", "p_weight"])
    return kept.withColumns({"existed": F.lit(len(existed)), "missing": F.lit(len(missing))})


@query("p16_bin_column", "event_id:l temp_bin:s wind_bin:s", """
SELECT event_id, CASE WHEN value > 0 AND value <= 60 THEN 'cold' WHEN value > 60 AND value <= 75 THEN 'cool'
  WHEN value > 75 AND value <= 85 THEN 'warm' WHEN value > 85 AND value <= 120 THEN 'hot' END AS temp_bin,
  CASE WHEN value > 0 AND value <= 5 THEN 'calm' WHEN value > 5 AND value <= 10 THEN 'light'
  WHEN value > 10 AND value <= 15 THEN 'moderate' WHEN value > 15 AND value <= 50 THEN 'strong' END AS wind_bin
FROM events""")
def _(spark, sf):
    return ev(spark, sf).select(
        "event_id", clean.bin_column(F.col("x"), *clean.BINS["temperature"]).alias("temp_bin"),
        clean.bin_column(F.col("x"), *clean.BINS["wind"]).alias("wind_bin"))


@query("p17_categorise_direction", "event_id:l direction:s", """
SELECT event_id, CASE WHEN value BETWEEN 45 AND 135 THEN 'favorable' WHEN value BETWEEN 225 AND 315
  THEN 'unfavorable' ELSE 'neutral' END AS direction FROM events""")
def _(spark, sf):
    return ev(spark, sf).select("event_id", clean.categorise_direction(F.col("x")).alias("direction"))


@query("p18_filter_last_days", "ent:l day:d x:f", f"""
WITH {LI} SELECT ent, day, sum(x) AS x FROM li WHERE day >= (SELECT max(day) FROM li) - 45 GROUP BY 1, 2""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("ent"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("x"))
    return clean.filter_last_days(rows, "day", 45).groupBy("ent", "day").agg(F.sum("x").alias("x"))


@query("p19_slice_target_date", "user_id:l day:d prior_n:l", f"""
WITH {EV_DAY}, w AS (SELECT user_id, day, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY day
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_n FROM d WHERE day >= DATE '2024-01-10')
SELECT * FROM w WHERE day = DATE '2024-01-20'""")
def _(spark, sf):
    history = ev_day(spark, sf).where(F.col("day") >= F.lit("2024-01-10").cast("date"))
    before = all_before(["user_id"], ["day"])
    built = history.withColumn("prior_n", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return clean.slice_target_date(built, "day", "2024-01-20")


@query("p20_infer_game_hour", "o_orderkey:l guess:i actual:i", """
SELECT o_orderkey, CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 13 WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 20
  ELSE 19 END AS guess, 0 AS actual FROM orders""")
def _(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", clean.infer_game_hour(d).alias("guess"), clean.infer_game_hour(d, F.col("o_orderdate")).alias("actual"))
