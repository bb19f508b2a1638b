"""Edge rows of window features against row-at-a-time restatements."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fairline.functions import arrays
from fairline.operators import clean, form, rolling, schedule, streak

START = dt.date(2024, 4, 1)


def games(seed, n=40):
    random.seed(seed)
    day, out = START, []
    for i in range(n):
        day += dt.timedelta(days=random.choice([0, 1, 1, 1, 2, 3, 9]))
        out.append(("e", day, i, random.randint(0, 1)))
    return out


def frame(spark, data):
    return schedule.numbered(spark.createDataFrame(data, "ent string, day date, tie int, hit int"), "day")


def test_fatigue_walk(spark):
    data = games(2)
    x, streak_, want, prev = 0.0, 0, {}, None
    for _, day, tie, _ in data:
        if prev is not None:
            gap = (day - prev).days
            if gap <= 1:
                streak_, x = streak_ + 1, x + 0.02 + (0.01 if gap == 0 else 0)
            else:
                streak_, x = 0, max(0.0, x - 0.05 * (gap - 1))
        want[tie], prev = (streak_, x), day
    for r in schedule.fatigue_state(frame(spark, data), "ent", "tie").collect():
        assert r.games_without_rest == want[r.tie][0] and abs(r.cumulative_fatigue - want[r.tie][1]) < 1e-9


def test_consecutive_games_tolerance_grows(spark):
    for seed in (3, 5):
        data = games(seed)
        got = {r.tie: r.consecutive_games for r in schedule.consecutive_games(frame(spark, data), "ent", "tie").collect()}
        for i, (_, day, tie, _) in enumerate(data):
            run, current = 1, day
            for j in range(i - 1, -1, -1):
                if (current - data[j][1]).days > run:
                    break
                run, current = run + 1, data[j][1]
            assert got[tie] == run


def test_thirty_day_window_ends_at_previous_row(spark):
    days = [0, 29, 30, 31, 62]
    df = spark.createDataFrame([("e", START + dt.timedelta(days=d), d, 1) for d in days], "ent string, day date, dn int, v int")
    got = [r.roll30d_v for r in rolling.rolling_days_lagged(df, ["ent"], "dn", ["v"], []).orderBy("dn").collect()]
    assert got == [None, 1, 2, 2, 3]


def test_decay_crosses_blocks_and_floor(spark):
    base = 1024 * 19
    data = [("e", base + d, float(v)) for d, v in [(-33, 3), (-20, 5), (-1, 7), (0, 11), (4, 2), (29, 1)]]
    df = spark.createDataFrame(data, "ent string, dn int, v double")
    decay = form.HOT_COLD
    for r in form.decayed_sums(df, ["ent"], "dn", {"s": F.col("v")}, decay).collect():
        want = sum(v * max(2.718281828459045 ** (-(r.dn - d) / decay.tau), decay.floor) for _, d, v in data if 1 <= r.dn - d <= decay.days)
        assert abs(r.s - want) < 1e-9


def test_array_fits(spark):
    import numpy as np
    df = spark.createDataFrame([([0.1, 0.4, 0.2, 0.9, 0.3],)], "a array<double>")
    r = df.select(arrays.slope(F.col("a")).alias("s"), arrays.curvature(F.col("a")).alias("c"), arrays.variance(F.col("a")).alias("v")).first()
    y = [0.1, 0.4, 0.2, 0.9, 0.3]
    assert abs(r.s - np.polyfit(range(5), y, 1)[0]) < 1e-12 and abs(r.c - np.polyfit(range(5), y, 2)[0]) < 1e-12
    assert abs(r.v - np.var(y, ddof=1)) < 1e-12


def test_single_row_entity_has_neutral_features(spark):
    df = spark.createDataFrame([("solo", START, 0, 1)], "ent string, day date, tie int, hit int")
    r = streak.streak_feature_set(df, "ent", "day", "tie", "hit").first()
    assert r.current_hot_streak == 0 and r.days_since_hot_streak is None and r.confidence_indicator == 0.0


def test_names_and_bins(spark):
    df = spark.createDataFrame([("Smith, Joe ",), (" Ann Lee",), (None,), ("a, b, c",)], "n string")
    assert [r.s for r in df.select(clean.standardise_name(F.col("n")).alias("s")).collect()] == ["Joe Smith", "Ann Lee", "", "b, c a"]
    edges = spark.createDataFrame([(0.0,), (60.0,), (60.5,), (120.0,), (121.0,)], "t double")
    assert [r.b for r in edges.select(clean.bin_column(F.col("t"), *clean.BINS["temperature"]).alias("b")).collect()] == [None, "cold", "cool", "hot", None]


def test_slg_of_whole_numbers_is_two_running_sums(spark):
    random.seed(11)
    rows = [(e, START + dt.timedelta(days=d), *[random.choice([None, 0, 0, 1, 3]) for _ in range(2)]) for e in ("a", "b") for d in range(25)]
    df = spark.createDataFrame(rows, "ent string, day date, tb_X bigint, ab_X bigint")
    plain, want = rolling.rolling_slg_wide(df, "ent", "day", ["X"], 4), {}
    for i, (e, day, *_) in enumerate(rows):
        last = [r for r in rows[max(0, i - 4) : i] if r[0] == e]
        tb, ab = ([r[c] for r in last if r[c] is not None] for c in (2, 3))
        want[(e, day)] = sum(tb) / sum(ab) if tb and sum(ab) > 0 else None
    assert {(r.ent, r.day): r.slg_X for r in plain.collect()} == want
    doubles = rolling.rolling_slg_wide(df.selectExpr("ent", "day", "CAST(tb_X AS DOUBLE) AS tb_X", "CAST(ab_X AS DOUBLE) AS ab_X"), "ent", "day", ["X"], 4)
    assert {(r.ent, r.day): r.slg_X for r in doubles.collect()} == want
    assert "specifiedwindowframe(RowFrame, -4, -1)" not in plain._jdf.queryExecution().analyzed().toString()
