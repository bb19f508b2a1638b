"""Streams over several small batches give the batch result."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fairline.operators import market as B
from fairline.operators import monitor as N
from fairline.sources import store as K
from fairline.streaming import jobs as J


def test_running_limit_over_batches(spark, tmp_path):
    random.seed(9)
    rows = [(i, dt.datetime(2024, 1, 1 + i // 30, 1 + (i % 30) // 2, i % 2 * 30), float(random.randint(1, 30))) for i in range(60)]
    df = spark.createDataFrame(rows, "key bigint, ts timestamp, stake double")
    for part in range(3):
        df.where((F.col("key") >= part * 20) & (F.col("key") < part * 20 + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = J.read_file_stream(spark, str(tmp_path / "in"), df.schema, 1).withColumn("day", F.to_date("ts"))
    J.accept_within_limit_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "day", "ts", "key", "stake", 100.0)
    got = {r.key: r.accepted for r in spark.read.parquet(str(tmp_path / "out" / "decided")).collect()}
    batch = B.accept_within_limit(df.withColumn("day", F.to_date("ts")), "day", ["ts", "key"], "key", "stake", 100.0)
    assert got == {r.key: r.accepted for r in batch.collect()}


def test_pair_totals_over_batches(spark, tmp_path):
    rows = [(i % 3, i % 4, dt.date(2024, 1, 1 + i % 20), 1, i % 2, float(i), float(-i)) for i in range(90)]
    df = spark.createDataFrame(rows, "b int, p int, day date, att int, hit int, x double, y double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = J.read_file_stream(spark, str(tmp_path / "in"), df.schema, 1)
    J.incremental_matchup_update(stream, str(tmp_path / "store"), str(tmp_path / "cp"), "b", "p", "day", "att", "hit", "x", "y")
    stored = {(r.b, r.p): (r.pa, r.hr, r.ev_sum) for r in K.read_totals(spark, str(tmp_path / "store")).collect()}
    whole = K.matchup_increment(df, "b", "p", "day", "att", "hit", "x", "y").collect()
    assert stored == {(r.b, r.p): (r.pa, r.hr, r.ev_sum) for r in whole}
    assert K._pointer(spark, str(tmp_path / "store")) == (3, 2)


def test_running_limit_over_many_arrow_batches(spark, tmp_path):
    random.seed(10)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * 3), random.randint(1, 3000) / 100) for i in range(25_000)]
    shuffled = rows[:]
    random.shuffle(shuffled)
    spark.createDataFrame(shuffled, "key bigint, ts timestamp, stake double").repartition(6).write.parquet(str(tmp_path / "in"))
    stream = J.read_file_stream(spark, str(tmp_path / "in"), "key bigint, ts timestamp, stake double").withColumn("day", F.to_date("ts"))
    J.accept_within_limit_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "day", "ts", "key", "stake", 900.0)
    got = {r.key for r in spark.read.parquet(str(tmp_path / "out" / "decided")).where("accepted = 1").collect()}
    total, want = 0, set()
    for key, _, stake in rows:
        if total + round(stake * 100) <= 90_000:
            total += round(stake * 100)
            want.add(key)
    assert got == want


def test_suppression_waits_for_the_watermark(spark, tmp_path):
    """Three micro-batches out of order give the batch result; keys whose time is over leave no state."""
    random.seed(11)
    start = dt.datetime(2024, 3, 1)
    moments = [(key, start + dt.timedelta(minutes=m, microseconds=random.randint(0, 999_999))) for key in "ab" for m in random.sample(range(600), 120)]
    df = spark.createDataFrame(moments, "rule string, at timestamp")
    ordered = sorted(moments, key=lambda r: r[1])
    parts = [ordered[0::3], ordered[1::3], ordered[2::3], [("end", start + dt.timedelta(days=30))], [("end", start + dt.timedelta(days=60))]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "rule string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = J.read_file_stream(spark, str(tmp_path / "in"), "rule string, at timestamp", 1)
    J.run_available(J.suppress_repeats_stream(stream, "rule", "at", 1800, late="12 hours"), str(tmp_path / "cp"), "append", J.batch_folder_sink(str(tmp_path / "out")))
    got = {(r.rule, r.moment) for r in spark.read.parquet(str(tmp_path / "out")).where("rule <> 'end'").collect()}
    micros = df.select("rule", F.unix_micros("at").alias("m"))
    want = {(r.rule, r.at) for r in N.suppress_repeats(micros, "rule", "m", 1800 * 1_000_000).select("rule", F.timestamp_micros("m").alias("at")).collect()}
    assert got == want and len(want) > 20
    left = spark.read.format("statestore").load(str(tmp_path / "cp")).select("key.*").collect()
    assert {r[0] for r in left} <= {"end"}


def test_pointers_keep_what_a_walk_keeps(spark):
    random.seed(12)
    rows = [(key, m) for key, span in (("dense", 3000), ("sparse", 200_000), ("one", 1)) for m in random.sample(range(span), min(span, 1500))] + [(None, 5)]
    got = {}
    for r in N.suppress_repeats(spark.createDataFrame(rows + rows[:50], "rule string, m long"), "rule", "m", 60).distinct().collect():
        got.setdefault(r.rule, []).append(r.m)
    for key in ("dense", "sparse", "one"):
        last, want = None, []
        for m in sorted(m for k, m in rows if k == key):
            if last is None or m - last >= 60:
                last = m
                want.append(m)
        assert sorted(got[key]) == want
    assert None not in got


def test_running_limit_waits_for_late_rows(spark, tmp_path):
    """Rows out of order over three batches, judged as in one; totals of days that are over are dropped."""
    random.seed(13)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=i * 20), float(random.randint(1, 30))) for i in range(300)]
    schema = "key bigint, ts timestamp, stake double"
    for part in range(3):
        spark.createDataFrame([r for r in rows if (r[0] // 5) % 3 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = J.read_file_stream(spark, str(tmp_path / "in"), schema, 1).withColumn("day", F.to_date("ts"))
    out = str(tmp_path / "out")
    J.accept_within_limit_stream(stream, out, str(tmp_path / "cp"), "day", "ts", "key", "stake", 100.0, late="5 days")
    assert spark.read.parquet(f"{out}/waiting/v3").count() > 0
    J.close_limit_stream(spark, out, "day", "key", "stake", 100.0)
    got = {r.key: r.accepted for r in spark.read.parquet(f"{out}/decided").collect()}
    batch = B.accept_within_limit(spark.createDataFrame(rows, schema).withColumn("day", F.to_date("ts")), "day", ["ts", "key"], "key", "stake", 100.0)
    assert got == {r.key: r.accepted for r in batch.collect()}


def test_totals_of_past_days_are_dropped(spark, tmp_path):
    start, schema = dt.datetime(2024, 1, 1, 12), "key bigint, ts timestamp, stake double"
    for k in range(4):
        spark.createDataFrame([(k, start + dt.timedelta(days=k), 5.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = J.read_file_stream(spark, str(tmp_path / "in"), schema, 1).withColumn("day", F.to_date("ts"))
    out = str(tmp_path / "out")
    J.accept_within_limit_stream(stream, out, str(tmp_path / "cp"), "day", "ts", "key", "stake", 100.0, late="1 hour")
    kept = [r.day for r in spark.read.parquet(f"{out}/used/v4").collect()]
    assert kept == [] or min(kept) >= dt.date(2024, 1, 4)
    assert {r.key for r in spark.read.parquet(f"{out}/decided").collect()} == {0, 1, 2}


def test_a_batch_rewrites_its_own_buckets(spark, tmp_path):
    schema = "b int, p int, day date, att int, hit int, x double, y double"

    def increment(rows):
        return K.matchup_increment(spark.createDataFrame(rows, schema), "b", "p", "day", "att", "hit", "x", "y")

    path, day = str(tmp_path / "store"), dt.date(2024, 1, 1)

    def add(rows, batch):
        return K.add_to_totals(spark, path, increment(rows), ["b", "p"], K.PAIR_SUMS, ["last_date"], batch)

    many = add([(b, p, day, 1, 0, 1.0, 2.0) for b in range(20) for p in range(20)], 0)
    assert len(many) == K.BUCKETS
    one = add([(3, 4, dt.date(2024, 2, 1), 1, 1, 5.0, 6.0)], 1)
    assert len(one) == 1 and len(list((tmp_path / "store" / "data" / "v2").glob("_bucket=*"))) == 1
    assert add([(3, 4, day, 1, 1, 5.0, 6.0)], 1) == [] and add([(9, 9, day, 1, 1, 5.0, 6.0)], 0) == []
    stored = {(r.b, r.p): (r.pa, r.hr, r.ev_sum, r.last_date) for r in K.read_totals(spark, path).collect()}
    assert len(stored) == 400 and stored[3, 4] == (2, 1, 6.0, dt.date(2024, 2, 1)) and stored[9, 9] == (1, 0, 1.0, day)
