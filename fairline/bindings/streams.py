"""T family: the driver tables read as file streams, results written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fairline.bindings.frames import LI
from fairline.bindings.monitoring import OPS, RATES, RULES, ops
from fairline.bindings.registry import ORACLES, query, table
from fairline.functions.durable import shared_folder
from fairline.operators import monitor as N
from fairline.sources import store as K
from fairline.streaming import jobs as J


def folders(spark) -> tuple[str, str]:
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def op_stream(spark, sf):
    """events as operations events, event time as a zoned timestamp (watermarks need one)."""
    stream = J.read_file_stream(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema)
    e, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("double").cast("int")
    return stream.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(e == "click", "odds_api").when(e == "view", "model_server").when(e == "error", "Prediction")
        .when(e == "signup", "store").otherwise("weather_api").alias("component"), F.concat(F.lit("type_"), k % 4).alias("kind"),
        F.when(F.col("value") > 120, "critical").when(F.col("value") > 40, "warning").otherwise("info").alias("severity"), "value", "user_id")


@query("t1_alert_rules_stream", "rule:s m:l rate:f")
def _(spark, sf):
    out, checkpoint = folders(spark)
    J.run_available(J.rule_minutes_stream(op_stream(spark, sf), "ts", "component", "severity", RULES), checkpoint, "update", J.batch_folder_sink(out))
    minutes = J.latest_rows(spark, out, ["rule", "minutes", "threshold", "alert_severity", "minute"])
    return N.suppress_repeats(N.trailing_alerts(minutes, RULES), "rule", "m", 60)


ORACLES["t1_alert_rules_stream"] = ORACLES["t1_alert_rules_batch"]


@query("t1_sliding_rule_stream", "rule:s window_end:s n:l", f"""
WITH {OPS}, s AS (SELECT date_trunc('minute', ts) + (i + 1) * INTERVAL 1 MINUTE AS window_end FROM op, range(60) t(i) WHERE component LIKE '%api%')
SELECT 'API Failure Rate' AS rule, strftime(window_end, '%Y-%m-%d %H:%M') AS window_end, count(*) AS n FROM s GROUP BY 2 HAVING count(*) / 60.0 >= 0.15""")
def _(spark, sf):
    out, checkpoint = folders(spark)
    J.run_available(J.alert_rules_stream(op_stream(spark, sf), "ts", "component", "severity", RULES[1]), checkpoint, "update", J.batch_folder_sink(out))
    return J.latest_rows(spark, out, ["rule", "window_end"]).withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd HH:mm"))


@query("t1_suppress_repeats_stream", "rule:s m:l", f"""SELECT rule, m FROM ({ORACLES['t1_alert_rules_batch']})""")
def _(spark, sf):
    """Alerts come in three files, out of order; a last file's far moment lets the watermark pass all others."""
    out, checkpoint = folders(spark)
    source = f"{out}_alerts"
    alerts = N.rule_minutes(ops(spark, sf), "ts", "component", "severity", RULES).select("rule", F.col("minute").cast("timestamp").alias("minute"))
    part = F.pmod(F.floor(F.unix_seconds("minute") / 300) + F.pmod(F.unix_seconds("minute") / 60, F.lit(2)), F.lit(3))
    late = alerts.agg((F.max(F.unix_seconds("minute")) - F.min(F.unix_seconds("minute")) + 1).alias("s")).first()["s"] or 1
    for k in range(3):
        alerts.where(part == k).coalesce(1).write.mode("append").parquet(source)
    alerts.groupBy().agg(F.max("minute").alias("minute")).select(F.lit("the end").alias("rule"), (F.col("minute") + F.make_dt_interval(secs=F.lit(2 * late + 172800))).alias("minute")).coalesce(1).write.mode("append").parquet(source)
    stream = J.read_file_stream(spark, source, "rule string, minute timestamp", 1)
    J.run_available(J.suppress_repeats_stream(stream, "rule", "minute", late=f"{late} seconds"), checkpoint, "append", J.batch_folder_sink(out))
    return spark.read.parquet(out).where("rule <> 'the end'").select("rule", (F.unix_seconds("moment") / 60).cast("bigint").alias("m"))


@query("t2_throughput_stream", "component:s window_start:s n:l rate_per_second:f", f"""
WITH {OPS}, {RATES} SELECT component, strftime(w, '%Y-%m-%d %H:%M') AS window_start, n, rate AS rate_per_second FROM rt""")
def _(spark, sf):
    out, checkpoint = folders(spark)
    J.run_available(J.throughput_stream(op_stream(spark, sf), "ts", "component", 600), checkpoint, "update", J.batch_folder_sink(out))
    return J.latest_rows(spark, out, ["component", "window_start"]).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("t3_accept_within_limit_stream", "event_id:l day:d accepted:i", """
WITH RECURSIVE t AS (SELECT event_id, CAST(ts AS DATE) AS day, value AS stake, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM events),
x AS (SELECT event_id, day, r, CASE WHEN stake <= 2000 THEN 1 ELSE 0 END AS accepted, CASE WHEN stake <= 2000 THEN stake ELSE 0 END AS used FROM t WHERE r = 1
  UNION ALL SELECT t.event_id, t.day, t.r, CASE WHEN used + stake <= 2000 THEN 1 ELSE 0 END, CASE WHEN used + stake <= 2000 THEN used + stake ELSE used END
  FROM x JOIN t ON t.day = x.day AND t.r = x.r + 1) SELECT event_id, day, accepted FROM x""")
def _(spark, sf):
    out, checkpoint = folders(spark)
    bets = op_stream(spark, sf).select("event_id", "ts", F.to_date("ts").alias("day"), F.col("value").alias("stake"))
    J.accept_within_limit_stream(bets, out, checkpoint, "day", "ts", "event_id", "stake", 2000.0, late="2 hours")
    J.close_limit_stream(spark, out, "day", "event_id", "stake", 2000.0)
    return spark.read.parquet(f"{out}/decided")


@query("t3_one_long_day_stream", "event_id:l accepted:i", """
WITH RECURSIVE t AS (SELECT event_id, CAST(round(value, 6) AS DECIMAL(30, 6)) AS stake, row_number() OVER (ORDER BY ts, event_id) AS r FROM events),
x AS (SELECT event_id, r, CASE WHEN stake <= 20000 THEN 1 ELSE 0 END AS accepted, CASE WHEN stake <= 20000 THEN stake ELSE CAST(0 AS DECIMAL(30, 6)) END AS used FROM t WHERE r = 1
  UNION ALL SELECT t.event_id, t.r, CASE WHEN used + stake <= 20000 THEN 1 ELSE 0 END, CAST(CASE WHEN used + stake <= 20000 THEN used + stake ELSE used END AS DECIMAL(30, 6))
  FROM x JOIN t ON t.r = x.r + 1) SELECT event_id, accepted FROM x""")
def _(spark, sf):
    out, checkpoint = folders(spark)
    bets = op_stream(spark, sf).select("event_id", "ts", F.lit("1998-01-01").cast("date").alias("day"), F.col("value").alias("stake"))
    J.accept_within_limit_stream(bets, out, checkpoint, "day", "ts", "event_id", "stake", 20000.0)
    return spark.read.parquet(f"{out}/decided")


@query("t4_incremental_matchup_update", "ent:l opp:l pa:l hr:l ev:f last_date:d", f"""
WITH {LI} SELECT ent, opp, sum(att) AS pa, sum(hit) AS hr, avg(x) AS ev, max(day) AS last_date FROM li GROUP BY 1, 2""")
def _(spark, sf):
    out, checkpoint = folders(spark)
    lines = J.read_file_stream(spark, f"{sf}/lineitem.parquet*", table(spark, sf, "lineitem").schema)
    owners = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("opp"))
    events = lines.join(owners, lines.l_orderkey == owners.o_orderkey).select(
        F.col("l_suppkey").alias("ent"), "opp", F.to_date("l_shipdate").alias("day"), (F.col("l_linestatus") == "F").cast("int").alias("att"),
        (F.col("l_discount") >= 0.08).cast("int").alias("hit"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("price"))
    J.incremental_matchup_update(events, out, checkpoint, "ent", "opp", "day", "att", "hit", "x", "price")
    return K.read_totals(spark, out).withColumn("ev", F.col("ev_sum") / F.col("ev_n"))
