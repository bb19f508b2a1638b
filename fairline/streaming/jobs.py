"""Structured Streaming versions of the alert, throughput, limit and pair-total jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairline.functions.durable import materialise
from fairline.operators.market import EXACT, accept_within_limit
from fairline.operators.monitor import AlertRule, matched_rules
from fairline.sources.store import PAIR_SUMS, add_to_totals, matchup_increment

_BATCH = "_batch"


def read_file_stream(spark: SparkSession, path: str, ddl, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder (or glob) as a stream with a fixed schema."""
    reader = spark.readStream.schema(ddl)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(stream: DataFrame, checkpoint: str, mode: str, write) -> None:
    """Process what is there and stop; ``write(batch, id)`` must give the same result when repeated."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def batch_folder_sink(path: str):
    """A sink with one folder per batch: a repeated batch overwrites its own folder only."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{_BATCH}={batch_id}")

    return write


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Updates of all batches reduced to the newest per key."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, _BATCH)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(_BATCH)).alias("_r")).select(*keys, "_r.*")


def rule_minutes_stream(errors: DataFrame, ts: str, component: str, severity: str, rules: list[AlertRule], late: str = "10 minutes") -> DataFrame:
    """Per rule and tumbling minute the number of matching events (update mode)."""
    hits = matched_rules(errors, ts, component, severity, rules).withWatermark("ts", late)
    return hits.groupBy("rule", "minutes", "threshold", "alert_severity", F.window("ts", "1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("n")).select("rule", "minutes", "threshold", "alert_severity", F.col("w.start").alias("minute"), "n")


def alert_rules_stream(errors: DataFrame, ts: str, component: str, severity: str, rule: AlertRule, late: str = "10 minutes") -> DataFrame:
    """T1 for one rule: sliding windows of its length, stepping a minute, whose rate reaches the threshold (update mode)."""
    mine = matched_rules(errors, ts, component, severity, [rule]).withWatermark("ts", late)
    counts = mine.groupBy("rule", F.window("ts", f"{rule.minutes} minutes", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    rated = counts.select("rule", F.col("w.end").alias("window_end"), "n", (F.col("n") / rule.minutes).alias("rate"))
    return rated.where(F.col("rate") >= rule.threshold)


def suppress_repeats_stream(alerts: DataFrame, key: str, ts: str, gap_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Drop an alert less than ``gap_seconds`` after the last one let through for its key (``key``, ``moment``).

    Moments wait in the state until the watermark has passed them, so rows that come out of order by up to ``late`` are
    judged as the batch operator judges them; later ones are dropped. What waits spans no more time than that. The
    state of a key goes when nothing waits and its last kept moment can't suppress anything any more.
    """
    gap = gap_seconds * 1_000_000

    def keep(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        moments = set(waiting)
        if not state.hasTimedOut:
            for frame in frames:
                moments.update(int(x) for x in frame["moment"])
        passed = state.getCurrentWatermarkMs() * 1000
        sent = []
        for moment in sorted(m for m in moments if m < passed):
            if last is None or moment - last >= gap:
                last = moment
                sent.append(moment)
        waiting = sorted(m for m in moments if m >= passed)
        if waiting or (last is not None and last + gap > passed):
            state.update((last, waiting))
            state.setTimeoutTimestamp((waiting[0] if waiting else last + gap) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: pd.Series([keys[0]] * len(sent), dtype=object), "moment": pd.Series(sent, dtype="int64")})

    kind = alerts.schema[key].dataType.simpleString()
    moments = alerts.withWatermark(ts, late).select(key, ts, F.unix_micros(ts).alias("moment"))
    kept = moments.groupBy(key).applyInPandasWithState(
        keep, f"{key} {kind}, moment bigint", "last bigint, waiting array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.withColumn("moment", F.timestamp_micros("moment"))


def throughput_stream(events: DataFrame, ts: str, operation: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Rows per second of tumbling windows (update mode)."""
    counts = events.withWatermark(ts, late).groupBy(operation, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(operation, F.col("w.start").alias("window_start"), "n", (F.col("n") / seconds).alias("rate_per_second"))


def _seconds(delay: str) -> int:
    """Length of a delay such as ``10 minutes``."""
    number, unit = delay.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def _stored(spark: SparkSession, path: str, name: str, version: int) -> DataFrame | None:
    return spark.read.parquet(f"{path}/{name}/v{version}") if version else None


def accept_within_limit_stream(
    bets: DataFrame, path: str, checkpoint: str, day: str, ts: str, key: str, stake: str, limit: float, late: str | None = None,
) -> None:
    """First-fit acceptance with a running total per day, one micro-batch after the other.

    Each batch is the batch operator on its rows in time order, starting from the days' totals so far, so neither the
    size of a day nor how its rows are cut into Arrow batches or files matters. With ``late`` rows wait until the newest
    row is that much younger, so rows out of order by up to ``late`` are judged as the batch operator judges them, and
    totals of days that are over are dropped; ``close_limit_stream`` decides what waits at the end. Rows that come later
    still, and without ``late`` all rows of an earlier time in a later batch, are judged after those already decided.

    Decisions go to ``decided/_batch=i``; batch ``i`` turns version ``i`` of ``used`` (totals), ``waiting`` (rows) and
    ``clock`` (newest time) into version ``i + 1``, so a repeated batch writes the same again.
    """
    def decide(batch: DataFrame, batch_id: int) -> None:
        _decide(batch.select(day, F.unix_micros(ts).alias("moment"), key, stake), path, batch_id, day, key, stake, limit, None if late is None else _seconds(late))

    run_available(bets, checkpoint, "append", decide)


def _decide(rows: DataFrame, path: str, batch_id: int, day: str, key: str, stake: str, limit: float, delay: int | None) -> None:
    spark = rows.sparkSession
    used, waiting, clock = (_stored(spark, path, n, batch_id) for n in ("used", "waiting", "clock"))
    rows = materialise(rows if waiting is None else rows.unionByName(waiting))
    newest = rows.agg(F.max("moment").alias("newest"))
    newest = materialise(newest if clock is None else newest.unionByName(clock).agg(F.max("newest").alias("newest")))
    passed = F.lit(None).cast("bigint") if delay is None else newest.select(F.col("newest") - delay * 1_000_000).scalar()
    waits = F.coalesce(F.col("moment") >= passed, F.lit(False))
    decided = materialise(accept_within_limit(rows.where(~waits), day, ["moment"], key, stake, limit, used=used))
    decided.select(day, key, F.col("accepted").cast("int").alias("accepted")).write.mode("overwrite").parquet(f"{path}/decided/{_BATCH}={batch_id}")
    taken = decided.where("accepted = 1").groupBy(day).agg(F.sum(F.col(stake).cast(EXACT)).cast(EXACT).alias("used"))
    total = taken if used is None else taken.unionByName(used).groupBy(day).agg(F.sum("used").cast(EXACT).alias("used"))
    over = F.coalesce(F.col(day) < F.to_date(F.timestamp_micros(passed)), F.lit(False))
    versions = {"used": total.where(~over), "waiting": rows.where(waits), "clock": newest}
    for name, table in versions.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/v{batch_id + 1}")


def close_limit_stream(spark: SparkSession, path: str, day: str, key: str, stake: str, limit: float) -> None:
    """Decide the rows that wait, as one more batch; to be called when no more rows come."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/waiting")
    folders = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    last = max(int(f.getPath().getName()[1:]) for f in folders)
    rows = spark.read.parquet(f"{path}/waiting/v{last}")
    _decide(rows.limit(0), path, last, day, key, stake, limit, None)


def incremental_matchup_update(
    events: DataFrame, path: str, checkpoint: str, entity: str, opponent: str, day: str, attempt: str, hit: str, impact: str, angle: str,
) -> None:
    """T4: fold new events into the stored pair totals.

    A batch rewrites the buckets of its pairs only and leaves its number; a batch repeated after a failure changes
    nothing or writes the same folder again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        increment = materialise(matchup_increment(batch, entity, opponent, day, attempt, hit, impact, angle))
        add_to_totals(batch.sparkSession, path, increment, [entity, opponent], PAIR_SUMS, ["last_date"], batch_id)

    run_available(events, checkpoint, "append", write)
