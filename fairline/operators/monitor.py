"""Operations events: error, latency and throughput summaries and alert rules (A22-A27, batch side of T1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.columns import first_matching
from fairline.functions.durable import materialise
from fairline.functions.ordering import nearest_positions


def since_hours(df: DataFrame, ts: str, hours: int, end: Column | None = None) -> DataFrame:
    """Rows after ``end - hours``; the default end is the newest row (a scalar subquery)."""
    last = end if end is not None else df.agg(F.max(ts).alias("last")).scalar()
    return df.where(F.col(ts) > last - F.make_dt_interval(hours=F.lit(hours)))


def error_summary(errors: DataFrame, ts: str, hours: int, component: str, kind: str, severity: str, end: Column | None = None) -> DataFrame:
    """Counts by component, type, severity and hour, and the overall count; rate per hour."""
    recent = since_hours(errors, ts, hours, end)
    parts = {"component": F.col(component), "type": F.col(kind), "severity": F.col(severity),
             "hour": F.date_format(F.date_trunc("hour", F.col(ts)), "yyyy-MM-dd HH:00"), "total": F.lit("all")}
    long = recent.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in parts.items()])).alias("d")).select("d.*")
    return long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("per_hour", F.col("n") / hours)


def top_patterns(errors: DataFrame, ts: str, component: str, kind: str, severity: str, message: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent component::type patterns with the newest row's severity and message."""
    newest = F.struct(F.col(ts), F.col(message), F.col(severity))
    return (
        errors.groupBy(F.concat_ws("::", component, kind).alias("pattern"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_seen"), F.max_by(F.struct(severity, message), newest).alias("_l"))
        .select("pattern", "n", "last_seen", F.col("_l")[severity].alias("last_severity"), F.col("_l")[message].alias("last_message"))
        .orderBy(F.desc("n"), "pattern").limit(k)
    )


def latency_summary(latencies: DataFrame, operation: str, duration: str, success: str, minimum: int = 20) -> DataFrame:
    """Count, mean, p95, p99 and success rate per operation.

    The percentile is the sorted value at index floor(n x q), given from
    ``minimum`` rows on; it is read from ranked value counts, not from a
    collected list.
    """
    plain = latencies.groupBy(operation).agg(
        F.count(F.lit(1)).alias("n"), F.avg(duration).alias("mean_ms"), F.min(duration).alias("min_ms"), F.max(duration).alias("max_ms"),
        F.avg(F.col(success).cast("int")).alias("success_rate"))
    tails = nearest_positions(latencies, [operation], duration, {"p95_ms": 0.95, "p99_ms": 0.99})
    enough = F.col("n") >= minimum
    return plain.join(tails, operation, "left").withColumns({c: F.when(enough, F.col(c)) for c in ("p95_ms", "p99_ms")})


def component_counts(latencies: DataFrame, component: str) -> DataFrame:
    """Rows per component."""
    return latencies.groupBy(component).agg(F.count(F.lit(1)).alias("n"))


def slow_operations(latencies: DataFrame, duration: str, threshold: float) -> DataFrame:
    """Rows above a duration; order them where they are read."""
    return latencies.where(F.col(duration) > threshold)


def threshold_breaches(latencies: DataFrame, limits: DataFrame, operation: str, duration: str, limit: str) -> DataFrame:
    """Operations whose mean exceeds their limit; critical from twice the limit on."""
    means = latencies.groupBy(operation).agg(F.avg(duration).alias("mean_ms"))
    over = means.join(limits, operation).where(F.col("mean_ms") > F.col(limit))
    return over.withColumn("severity", F.when(F.col("mean_ms") >= 2 * F.col(limit), "critical").otherwise("warning"))


def throughput_rates(events: DataFrame, ts: str, operation: str, seconds: int) -> DataFrame:
    """T2, batch: rows per second of each tumbling window."""
    window = F.window(F.col(ts), f"{seconds} seconds")
    return events.groupBy(operation, window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        operation, F.col("w.start").alias("window_start"), "n", (F.col("n") / seconds).alias("rate_per_second"))


def throughput_summary(rates: DataFrame, operation: str, rate: str = "rate_per_second") -> DataFrame:
    """Mean, highest and lowest rate and number of measurements per operation."""
    return rates.groupBy(operation).agg(
        F.avg(rate).alias("avg_rate"), F.max(rate).alias("max_rate"), F.min(rate).alias("min_rate"), F.count(F.lit(1)).alias("measurements"))


def status_from_rates(calls: DataFrame, group: str, success: str, duration: str) -> DataFrame:
    """Critical below 50 % success, warning below 80 % or above 5 s mean, else healthy."""
    out = calls.groupBy(group).agg(F.avg(F.col(success).cast("int")).alias("success_rate"), F.avg(duration).alias("mean_ms"), F.count(F.lit(1)).alias("tests"))
    return out.withColumn("status", first_matching([
        (F.col("success_rate") < 0.5, F.lit("critical")), ((F.col("success_rate") < 0.8) | (F.col("mean_ms") > 5000), F.lit("warning"))], F.lit("healthy")))


def status_from_errors(errors: DataFrame, group: str) -> DataFrame:
    """Critical above 50 errors, warning above 10."""
    out = errors.groupBy(group).agg(F.count(F.lit(1)).alias("error_count"))
    return out.withColumn("status", first_matching([
        (F.col("error_count") > 50, F.lit("critical")), (F.col("error_count") > 10, F.lit("warning"))], F.lit("healthy")))


@dataclass(frozen=True)
class AlertRule:
    """Alert when matching events per minute over the trailing window reach the threshold."""

    name: str
    minutes: int
    threshold: float
    severity: str
    words: tuple[str, ...] = ()
    only_severity: str | None = None

    def matches(self, component: Column, severity: Column) -> Column:
        out = F.lit(True)
        if self.words:
            out = F.lit(False)
            for word in self.words:
                out = out | F.lower(component).contains(word)
        return out & (severity == self.only_severity) if self.only_severity else out


# The default alert rules.
DEFAULT_RULES = [
    AlertRule("High Error Rate", 5, 10.0, "critical"),
    AlertRule("API Failure Rate", 5, 5.0, "warning", words=("api",)),
    AlertRule("Model Prediction Failures", 10, 3.0, "critical", words=("prediction", "model")),
    AlertRule("Critical System Errors", 1, 1.0, "critical", only_severity="critical"),
]


def matched_rules(errors: DataFrame, ts: str, component: str, severity: str, rules: list[AlertRule]) -> DataFrame:
    """(rule, window, threshold, ts) for every rule an error counts towards."""
    hits = F.array(*[
        F.when(r.matches(F.col(component), F.col(severity)), F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.minutes).alias("minutes"), F.lit(r.threshold).alias("threshold"),
            F.lit(r.severity).alias("alert_severity")))
        for r in rules
    ])
    return errors.select(F.col(ts).alias("ts"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("ts", "h.*")


def rule_minutes(errors: DataFrame, ts: str, component: str, severity: str, rules: list[AlertRule]) -> DataFrame:
    """T1, batch: per rule and minute the trailing event rate, for minutes that reach the threshold.

    Events collapse to (rule, minute) counts before the window, so it runs over
    calendar minutes however many events there are.
    """
    minutes = matched_rules(errors, ts, component, severity, rules).groupBy(
        "rule", "minutes", "threshold", "alert_severity", F.date_trunc("minute", "ts").alias("minute")
    ).agg(F.count(F.lit(1)).alias("n"))
    return trailing_alerts(minutes, rules)


def trailing_alerts(minutes: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """Trailing rates of (rule, minute) counts that reach their rule's threshold, with the minute number ``m``."""
    numbered = minutes.withColumn("m", F.timestamp_diff(
        "MINUTE", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("minute").cast("timestamp_ntz")))
    w = Window.partitionBy("rule").orderBy("m")
    longest = sorted({r.minutes for r in rules})
    trailing = first_matching([
        (F.col("minutes") == k, F.sum("n").over(w.rangeBetween(-(k - 1), 0))) for k in longest])
    return numbered.withColumn("rate", trailing / F.col("minutes")).where(F.col("rate") >= F.col("threshold"))


def suppress_repeats(alerts: DataFrame, key: str, order: str, gap: int) -> DataFrame:
    """T1, batch: keep an alert only if the last kept one of its key is at least ``gap`` order units back.

    Every moment points to the first one at least ``gap`` later. The kept ones are what is reached from a key's first
    moment; pointers are doubled until none is left, then the longest ones are followed first, each doubling the kept
    moments. Work is linear in a round, rounds grow with the logarithm of the kept moments, and no task holds a key.
    """
    moments = materialise(alerts.select(key, F.col(order).alias("m")).distinct())
    later = Window.partitionBy(key).orderBy(F.desc("m")).rangeBetween(Window.unboundedPreceding, -gap)
    jumps = [materialise(moments.select(key, "m", F.min("m").over(later).alias("to")).where("to is not null"))]
    while True:
        once = jumps[-1]
        twice = materialise(once.join(once.select(key, F.col("m").alias("to"), F.col("to").alias("_to")), [key, "to"]).select(key, "m", F.col("_to").alias("to")))
        if twice.isEmpty():
            break
        jumps.append(twice)
    kept = materialise(moments.groupBy(key).agg(F.min("m").alias("m")))
    for jump in reversed(jumps):
        kept = materialise(kept.unionByName(kept.join(jump, [key, "m"]).select(key, F.col("to").alias("m"))))
    return alerts.join(kept.withColumnRenamed("m", order), [key, order])
