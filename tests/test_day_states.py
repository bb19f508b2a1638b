"""Day states of streaks: any number of games on a day, same features as from the list of games."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fairline.operators import streak as S

DAY = dt.date(2024, 5, 1)
GAMES = "who string, day date, tie long, hit int, lev int, clu int"


def features(spark, rows):
    df = spark.createDataFrame(rows, GAMES)
    out = S.streak_feature_set(df, "who", "day", "tie", "hit", "lev", "clu")
    return {(r["who"], r["day"]): r for r in out.collect()}


def by_list(rows, who, day):
    """Confidence, toughness, pressure, rhythm and clutch slope from the games of the 21 days before, in order."""
    games = sorted((r for r in rows if r[0] == who and day - dt.timedelta(21) <= r[1] < day), key=lambda r: (r[1], r[2]))
    hits = [r[3] for r in games]
    n = len(hits)

    def variance(x):
        m = sum(x) / len(x)
        return sum((v - m) ** 2 for v in x) / (len(x) - 1)

    last = hits[-5:]
    confidence = min(sum(last) / len(last) / max(sum(hits) / n, 0.01) / (1 + 5 * variance(last)), 2.0)
    chances = [c for a, b, c in zip(hits, hits[1:], hits[2:]) if a == 0 and b == 0]
    tough = sum(chances) / len(chances) if chances else 0.0
    rate = lambda flag: [r[3] for r in games if r[4] == flag]
    high, low = rate(1), rate(0)
    pressure = (sum(high) / len(high)) / max(sum(low) / len(low), 0.01) if high and low else 0.0
    days = [r[1].toordinal() for r in games if r[3] == 1]
    gaps = [b - a for a, b in zip(days, days[1:])]
    rhythm = 1 / (1 + variance(gaps) / 5) if len(days) >= 3 else 0.0
    clutch = [(r[1], r[3]) for r in games if r[5] == 1][-5:]
    means = []
    for d in dict.fromkeys(c[0] for c in clutch):
        own = [c[1] for c in clutch if c[0] == d]
        means.append(sum(own) / len(own))
    k = len(means)
    slope = sum(y * (i - (k - 1) / 2) for i, y in enumerate(means)) * 12 / (k * (k * k - 1)) if k > 1 else 0.0
    return confidence, tough, pressure, rhythm, slope


NAMES = ["confidence_indicator", "mental_toughness", "pressure_response", "rhythm_indicator", "clutch_momentum"]


@pytest.mark.parametrize("most", [1, 2, 3, 9])
def test_features_equal_those_of_the_list(spark, most):
    rng = random.Random(most)
    rows = []
    for who in "abc":
        for d in range(30):
            for tie in range(rng.randint(0, most)):
                rows.append((who, DAY + dt.timedelta(d), tie, int(rng.random() < 0.35), rng.randint(0, 1), int(rng.random() < 0.4)))
    got, checked = features(spark, rows), 0
    for (who, day), r in got.items():
        if sum(1 for x in rows if x[0] == who and day - dt.timedelta(21) <= x[1] < day) >= 5:
            checked += 1
            for name, want in zip(NAMES, by_list(rows, who, day)):
                assert abs(r[name] - want) < 1e-9, (name, who, day)
    assert checked > 20


def test_a_day_of_very_many_games(spark):
    rng = random.Random(4)
    rows = [("hot", DAY, i, int(rng.random() < 0.2), i % 2, int(i % 3 == 0)) for i in range(100_000)]
    rows += [("hot", DAY + dt.timedelta(k), 0, k % 2, 1, 1) for k in (1, 3, 4)]
    r = features(spark, rows)["hot", DAY + dt.timedelta(4)]
    for name, want in zip(NAMES, by_list(rows, "hot", DAY + dt.timedelta(4))):
        assert abs(r[name] - want) < 1e-9, name
    state = S.day_states(spark.createDataFrame(rows, GAMES), "who", "day", "tie", "hit", "lev", "clu").where(F.col("day") == DAY).first()
    assert state["n"] == 100_000 and len(state["last"]) == S.NEWEST and len(state["clutch"]) == S.NEWEST
