"""Pricing on literal quotes, first-fit acceptance and sizing against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fairline.functions.ordering import running_totals
from fairline.operators import market as B


# Four recorded quotes (score, price, expected value, Kelly share, fair price).
def test_recorded_prices(spark):
    rows = [("a", 0.097, 2730.0, 1.739, 0.064, 933.0), ("b", 0.195, 1250.0, 1.627, 0.130, 414.0), ("c", 0.087, 2800.0, 1.514, 0.054, 1054.0),
            ("d", 0.237, 750.0, 1.016, 0.136, 322.0)]
    df = spark.createDataFrame(rows, "name string, p double, odds double, ev double, kelly double, fair double")
    for r in B.price_market(df, "p", "odds").collect():
        spread = 0.0005 * (r.odds / 100 + 1) + 0.001
        assert abs(r.expected_value - r.ev) <= spread
        assert abs(r.kelly_fraction - r.kelly) <= 0.0015
        low, high = (1 - r.p - 0.0005) / (r.p + 0.0005) * 100, (1 - r.p + 0.0005) / (r.p - 0.0005) * 100
        assert low - 1 <= r.fair <= high + 1


def test_simple_opportunities_keep_only_clear_value(spark):
    df = spark.createDataFrame([("one", 0.15, 650.0), ("two", 0.08, 850.0), ("three", 0.20, 400.0)], "name string, p double, odds double")
    kept = B.simple_opportunities(df, "p", "odds").collect()
    assert [(r.name, round(r.ev, 6)) for r in kept] == [("one", 0.125)]


def test_edge_prices(spark):
    df = spark.createDataFrame([(0.0, 100.0), (1.0, -100.0), (0.5, 0.0), (0.3, None)], "p double, odds double")
    out = B.price_market(df, "p", "odds").collect()
    assert out[0].kelly_fraction == 0.0 and out[2].kelly_fraction == 0.0
    assert out[3].expected_value is None and out[3].kelly_fraction is None and out[3].implied_probability is None
    assert out[1].implied_probability == 0.5


@pytest.mark.parametrize("fold_rows", [3, 1000])
def test_first_fit_matches_loop(spark, fold_rows):
    random.seed(4)
    bets = [(i, f"2024-01-0{1 + (i % 7 == 0)}", float(random.choice([1, 2, 5, 9, 30, 60]))) for i in range(160)]
    totals, want = {}, {}
    for key, day, stake in bets:
        fits = totals.get(day, 0.0) + stake <= 50.0
        totals[day] = totals.get(day, 0.0) + (stake if fits else 0.0)
        want[key] = int(fits)
    df = spark.createDataFrame(bets, "key bigint, day string, stake double").withColumn("day", F.to_date("day"))
    got = {r.key: r.accepted for r in B.accept_within_limit(df, "day", ["key"], "key", "stake", 50.0, fold_rows).collect()}
    assert got == want


def test_sizing_stops_at_the_daily_limit(spark):
    rows = [(i, "2024-05-01", 1.0 / (i + 1), 0.01 * (i % 9)) for i in range(40)]
    df = spark.createDataFrame(rows, "key int, day string, expected_value double, kelly_fraction double").withColumn("day", F.to_date("day"))
    spent, want = 0.0, {}
    for key, _, _, kelly in rows:
        if spent >= 100.0:
            break
        want[key] = max(0.0, min(kelly * 1000, 50.0, 100.0 - spent))
        spent += want[key]
    got = {r.key: r.recommended_bet for r in B.size_bets_greedy_cap(df, "day", "key").collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_calibration_of_listed_scores(spark):
    scores = [0.834, 0.715, 0.949, 0.855, 0.720, 0.705, 0.500, 0.400, 0.300]
    df = spark.createDataFrame([(s,) for s in scores], "p double")
    out = {r.p: r.calibrated for r in B.calibrate_percentile(df, "p").collect()}
    assert out[0.949] == pytest.approx(0.35) and out[0.300] == pytest.approx(0.05 + 100 / 9 * 0.07 / 50)
    assert sorted(out, key=out.get) == sorted(out)


def first_fit(bets, limit):
    """Accepted keys of (key, stake) in order, in hundredths."""
    total, taken = 0, set()
    for key, stake in bets:
        if total + round(stake * 100) <= round(limit * 100):
            total += round(stake * 100)
            taken.add(key)
    return taken


@pytest.mark.parametrize("kind", ["alternating", "falling", "random"])
def test_passes_grow_with_the_logarithm(spark, monkeypatch, kind):
    """100,000 bets on a day: tiny and large ones in turn, stakes that just miss, or any."""
    rng = random.Random(6)
    n, limit = 100_000, 10_000.0
    if kind == "alternating":
        bets = [(i, 0.05 if i % 2 else 9_000.0) for i in range(n)]
    elif kind == "falling":
        bets = [(i, 0.01 if i % 2 else round(limit - 0.01 * (i // 2) + 0.01, 2)) for i in range(n)]
    else:
        bets = [(i, rng.choice([0.01, 0.5, 3.0, 700.0, 2500.0]) * rng.randint(1, 3)) for i in range(n)]
    passes = []
    plain = B.running_totals
    monkeypatch.setattr(B, "running_totals", lambda *a, **k: passes.append(1) or plain(*a, **k))
    df = spark.createDataFrame(bets, "key bigint, stake double").withColumn("day", F.lit("2024-01-01").cast("date"))
    got = {r.key for r in B.accept_within_limit(df, "day", ["key"], "key", "stake", limit, fold_rows=100).where("accepted = 1").collect()}
    assert got == first_fit(bets, limit) and 0 < len(passes) <= 22


def test_a_full_day_needs_no_halving(spark, monkeypatch):
    """Stakes that aren't tiny fill a day within its first bets; the rest is looked at once."""
    calls = []
    monkeypatch.setattr(B, "running_totals", lambda *a, **k: calls.append(1) or running_totals(*a, **k))
    rows = [(k, dt.date(2024, 4, 1), float((k * 37) % 97 + 3)) for k in range(3000)]
    left, want = 2000.0, set()
    for k, _, stake in rows:
        if stake <= left:
            left, want = left - stake, want | {k}
    df = spark.createDataFrame(rows, "key long, day date, stake double")
    got = B.accept_within_limit(df, "day", ["key"], "key", "stake", 2000.0, fold_rows=100)
    assert {r.key for r in got.where("accepted = 1").collect()} == want
    assert not calls
