"""Bindings of the driver tables to the roles operators expect, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.bindings.registry import table
from fairline.functions.columns import day_number
from fairline.functions.parallel import dealt_out


def ev(spark: SparkSession, sf: str) -> DataFrame:
    """events: entity user_id, hit = purchase, attempt = anything but view, x = value, angle = props.k."""
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("day"), F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("angle"),
        (F.col("event_type") == "purchase").cast("int").alias("hit"),
        (F.col("event_type") != "view").cast("int").alias("att"),
        F.hour("ts").alias("hr"),
    )


EV = """ev AS (SELECT event_id, ts, user_id, event_type, CAST(ts AS DATE) AS day, value AS x,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS angle,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS hit,
  CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END AS att,
  CAST(hour(ts) AS INTEGER) AS hr FROM events)"""


def ev_day(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (user, day); every window over it is bounded by the calendar."""
    return (
        ev(spark, sf).groupBy("user_id", "day")
        .agg(F.sum("att").alias("att"), F.sum("hit").alias("hit"), F.avg("x").alias("x"),
             F.avg("angle").alias("angle"), F.count(F.lit(1)).alias("n"))
        .withColumn("dn", day_number("day"))
    )


EV_DAY = EV + """, d AS (SELECT user_id, day, CAST(sum(att) AS BIGINT) AS att, CAST(sum(hit) AS BIGINT) AS hit,
  avg(x) AS x, avg(angle) AS angle, count(*) AS n, CAST(datediff('day', DATE '1970-01-01', day) AS INTEGER) AS dn
  FROM ev GROUP BY user_id, day)"""


def li(spark: SparkSession, sf: str, parts: int | None = None) -> DataFrame:
    """lineitem with part, order, customer and supplier: entity supplier, opponent = customer nation.

    Customers meet the orders first, so the lines, the largest table, are not shuffled for them. With ``parts`` no task
    sorts more lines for a larger table: lines and orders are dealt out to that many tasks, and the lines stream past
    hash tables of the parts (a part with many lines can still be split).
    """
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", F.col("l_suppkey").alias("ent"), F.to_date("l_shipdate").alias("day"),
        F.col("l_linenumber").alias("inning"), F.col("l_returnflag").alias("hand"), F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("price"), (F.col("l_discount") >= 0.08).cast("int").alias("hit"),
        (F.col("l_linestatus") == "F").cast("int").alias("att"),
    )
    kinds = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("kind"), F.col("p_size").alias("speed"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"))
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("opp"))
    owners = orders.join(customers, F.col("cust") == F.col("c_custkey"))
    suppliers = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("park"))
    if parts is not None:
        kinds = kinds.hint("shuffle_hash")
    described = lines.join(kinds, F.col("l_partkey") == F.col("p_partkey"))
    return (
        dealt_out(described, parts, "l_orderkey")
        .join(dealt_out(owners, parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("ent") == F.col("s_suppkey"))
        .drop("p_partkey", "o_orderkey", "c_custkey", "s_suppkey")
    )


LI = """li AS (SELECT l_orderkey, l_partkey, l_suppkey AS ent, CAST(l_shipdate AS DATE) AS day, l_linenumber AS inning,
  l_returnflag AS hand, l_quantity AS x, l_extendedprice AS price,
  CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END AS hit, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS att,
  p_type AS kind, p_size AS speed, o_custkey AS cust, c_nationkey AS opp, s_nationkey AS park
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def odds_board(spark: SparkSession, sf: str) -> DataFrame:
    """orders as a market: key player, score p in (0, 1), American price from the order key and total."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("offer"), F.col("o_custkey").alias("player"), F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("bookmaker"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"),
        (F.col("o_totalprice") / 1000000.0).alias("p"),
        F.when(F.col("o_orderkey") % 7 == 0, -100.0 - F.col("o_custkey") % 300)
        .when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast("double"))
        .otherwise(100.0 + F.col("o_orderkey") % 900).alias("odds_yes"),
        (-100.0 - F.col("o_orderkey") % 1100).alias("odds_no"),
    )


BOARD = """board AS (SELECT o_orderkey AS offer, o_custkey AS player, CAST(o_orderdate AS DATE) AS date,
  o_orderpriority AS bookmaker, o_orderstatus AS status, o_totalprice AS total,
  o_totalprice / 1000000.0 AS p,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(-100 - o_custkey % 300 AS DOUBLE)
       WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(100 + o_orderkey % 900 AS DOUBLE) END AS odds_yes,
  CAST(-100 - o_orderkey % 1100 AS DOUBLE) AS odds_no FROM orders)"""
