"""A22-A27 and the batch side of T1 and T2 on events read as operations events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.bindings.frames import EV, ev
from fairline.bindings.registry import query
from fairline.operators import monitor as N

OPS = EV + """, op AS (SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'odds_api' WHEN 'view' THEN 'model_server' WHEN 'error' THEN 'Prediction' WHEN 'signup' THEN 'store'
  ELSE 'weather_api' END AS component, 'type_' || CAST(angle AS INTEGER) % 4 AS kind, CASE WHEN x > 120 THEN 'critical' WHEN x > 40 THEN 'warning' ELSE 'info' END AS severity,
  'k' || CAST(angle AS INTEGER) AS message, x * 20 AS ms, CASE WHEN event_type <> 'error' AND x < 110 THEN 1 ELSE 0 END AS ok FROM ev)"""


def ops(spark, sf):
    e, k = F.col("event_type"), F.col("angle").cast("int")
    return ev(spark, sf).select(
        "event_id", "ts", F.when(e == "click", "odds_api").when(e == "view", "model_server").when(e == "error", "Prediction").when(e == "signup", "store")
        .otherwise("weather_api").alias("component"), F.concat(F.lit("type_"), k % 4).alias("kind"),
        F.when(F.col("x") > 120, "critical").when(F.col("x") > 40, "warning").otherwise("info").alias("severity"),
        F.concat(F.lit("k"), k).alias("message"), (F.col("x") * 20).alias("ms"), ((e != "error") & (F.col("x") < 110)).cast("int").alias("ok"))


@query("a22_error_summary", "dimension:s value:s n:l per_hour:f", f"""
WITH {OPS}, r AS (SELECT * FROM op WHERE ts > (SELECT max(ts) FROM op) - INTERVAL 72 HOUR), l AS (SELECT 'component' AS dimension, component AS value FROM r
  UNION ALL SELECT 'type', kind FROM r UNION ALL SELECT 'severity', severity FROM r UNION ALL SELECT 'hour', strftime(ts, '%Y-%m-%d %H:00') FROM r UNION ALL SELECT 'total', 'all' FROM r)
SELECT dimension, value, count(*) AS n, count(*) / 72 AS per_hour FROM l GROUP BY 1, 2""")
def _(spark, sf):
    return N.error_summary(ops(spark, sf), "ts", 72, "component", "kind", "severity")


@query("a23_top_patterns", "pattern:s n:l last_seen:s last_severity:s last_message:s", f"""
WITH {OPS} SELECT component || '::' || kind AS pattern, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, arg_max(severity, ts) AS last_severity,
  arg_max(message, ts) AS last_message FROM op GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    return N.top_patterns(ops(spark, sf), "ts", "component", "kind", "severity", "message").withColumn(
        "last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query("a24_latency_summary", "component:s n:l mean_ms:f min_ms:f max_ms:f p95_ms:f p99_ms:f success_rate:f", f"""
WITH {OPS}, s AS (SELECT component, list(ms ORDER BY ms) AS v, count(*) AS n, avg(ms) AS mean_ms, min(ms) AS min_ms, max(ms) AS max_ms, avg(ok) AS success_rate FROM op GROUP BY 1)
SELECT *, v[CAST(floor(n * 0.95) AS INTEGER) + 1] AS p95_ms, v[CAST(floor(n * 0.99) AS INTEGER) + 1] AS p99_ms FROM s""")
def _(spark, sf):
    return N.latency_summary(ops(spark, sf), "component", "ms", "ok")


@query("a24_component_counts", "component:s n:l", f"WITH {OPS} SELECT component, count(*) AS n FROM op GROUP BY 1")
def _(spark, sf):
    return N.component_counts(ops(spark, sf), "component")


@query("a25_slow_operations", "event_id:l component:s ms:f", f"WITH {OPS} SELECT event_id, component, ms FROM op WHERE ms > 2500")
def _(spark, sf):
    return N.slow_operations(ops(spark, sf), "ms", 2500)


@query("a25_threshold_breaches", "component:s mean_ms:f max_ms:f severity:s", f"""
WITH {OPS}, l AS (SELECT CASE WHEN component = 'store' THEN 'other' ELSE component END AS component, avg(ms) / CASE WHEN component LIKE '%api' THEN 2.5 ELSE 1.2 END AS max_ms FROM op GROUP BY op.component),
m AS (SELECT component, avg(ms) AS mean_ms FROM op GROUP BY 1) SELECT component, mean_ms, max_ms, CASE WHEN mean_ms >= 2 * max_ms THEN 'critical' ELSE 'warning' END AS severity
FROM m JOIN l USING (component) WHERE mean_ms > max_ms""")
def _(spark, sf):
    rows = ops(spark, sf)
    limits = rows.groupBy("component").agg(F.avg("ms").alias("m")).select(
        F.when(F.col("component") == "store", "other").otherwise(F.col("component")).alias("component"), (F.col("m") / F.when(F.col("component").endswith("api"), 2.5).otherwise(1.2)).alias("max_ms"))
    return N.threshold_breaches(rows, limits, "component", "ms", "max_ms")


RATES = "rt AS (SELECT component, time_bucket(INTERVAL 600 SECOND, ts) AS w, count(*) AS n, count(*) / 600.0 AS rate FROM op GROUP BY 1, 2)"


@query("a26_throughput_summary", "component:s avg_rate:f max_rate:f min_rate:f measurements:l", f"""
WITH {OPS}, {RATES} SELECT component, avg(rate) AS avg_rate, max(rate) AS max_rate, min(rate) AS min_rate, count(*) AS measurements FROM rt GROUP BY 1""")
def _(spark, sf):
    return N.throughput_summary(N.throughput_rates(ops(spark, sf), "ts", "component", 600), "component")


@query("t2_throughput_batch", "component:s window_start:s n:l rate_per_second:f", f"""
WITH {OPS}, {RATES} SELECT component, strftime(w, '%Y-%m-%d %H:%M') AS window_start, n, rate AS rate_per_second FROM rt""")
def _(spark, sf):
    return N.throughput_rates(ops(spark, sf), "ts", "component", 600).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("a27_status_from_rates", "kind:s success_rate:f mean_ms:f tests:l status:s", f"""
WITH {OPS}, g AS (SELECT component || kind AS kind, avg(ok) AS success_rate, avg(ms) * 4.5 AS mean_ms, count(*) AS tests FROM op GROUP BY 1)
SELECT *, CASE WHEN success_rate < 0.5 THEN 'critical' WHEN success_rate < 0.8 OR mean_ms > 5000 THEN 'warning' ELSE 'healthy' END AS status FROM g""")
def _(spark, sf):
    rows = ops(spark, sf).select(F.concat("component", "kind").alias("kind"), "ok", (F.col("ms") * 4.5).alias("ms"))
    return N.status_from_rates(rows, "kind", "ok", "ms")


@query("a27_status_from_errors", "hour:s error_count:l status:s", f"""
WITH {OPS}, g AS (SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS error_count FROM op GROUP BY 1)
SELECT *, CASE WHEN error_count > 50 THEN 'critical' WHEN error_count > 10 THEN 'warning' ELSE 'healthy' END AS status FROM g""")
def _(spark, sf):
    return N.status_from_errors(ops(spark, sf).withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH")), "hour")


# The test stream has an event every few minutes: the rules keep their shape with windows and limits of its own scale.
RULES = [
    N.AlertRule("High Error Rate", 60, 0.3, "critical"), N.AlertRule("API Failure Rate", 60, 0.15, "warning", words=("api",)),
    N.AlertRule("Model Prediction Failures", 120, 0.13, "critical", words=("prediction", "model")),
    N.AlertRule("Critical System Errors", 30, 0.03, "critical", only_severity="critical"),
]


@query("t1_alert_rules_batch", "rule:s m:l rate:f", f"""
WITH RECURSIVE {OPS}, k AS (SELECT 'High Error Rate' AS rule, 60 AS w, 0.3 AS lim, ts FROM op UNION ALL SELECT 'API Failure Rate', 60, 0.15, ts FROM op WHERE component LIKE '%api%'
  UNION ALL SELECT 'Model Prediction Failures', 120, 0.13, ts FROM op WHERE lower(component) LIKE '%prediction%' OR lower(component) LIKE '%model%'
  UNION ALL SELECT 'Critical System Errors', 30, 0.03, ts FROM op WHERE severity = 'critical'),
c AS (SELECT rule, w, lim, CAST(epoch(date_trunc('minute', ts)) / 60 AS BIGINT) AS m, count(*) AS n FROM k GROUP BY 1, 2, 3, 4),
r AS (SELECT a.rule, a.m, sum(b.n) / CAST(a.w AS DOUBLE) AS rate FROM c a JOIN c b ON a.rule = b.rule AND b.m > a.m - a.w AND b.m <= a.m GROUP BY a.rule, a.m, a.w, a.lim
  HAVING sum(b.n) / CAST(a.w AS DOUBLE) >= any_value(a.lim)),
kept AS (SELECT rule, min(m) AS m FROM r GROUP BY 1 UNION ALL SELECT kept.rule, (SELECT min(r.m) FROM r WHERE r.rule = kept.rule AND r.m >= kept.m + 60) AS m
  FROM kept WHERE EXISTS (SELECT 1 FROM r WHERE r.rule = kept.rule AND r.m >= kept.m + 60))
SELECT r.* FROM r JOIN kept USING (rule, m)""")
def _(spark, sf):
    return N.suppress_repeats(N.rule_minutes(ops(spark, sf), "ts", "component", "severity", RULES), "rule", "m", 60)
