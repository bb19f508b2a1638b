"""Isotonic regression against plain pooling, however the scores are cut into ranges."""

import random

import pytest
from pyspark.sql import functions as F

from fairline.operators import calibrate as C


def pooled(rows):
    """{score: value} by pooling adjacent violators over all scores in one list."""
    sums = {}
    for p, y in rows:
        n, s = sums.get(p, (0, 0.0))
        sums[p] = (n + 1, s + y)
    blocks = []
    for p in sorted(sums):
        n, s = sums[p]
        blocks.append([[p], n, s])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return {p: s / n for scores, n, s in blocks for p in scores}


def samples(kind):
    rng = random.Random(8)
    if kind == "noise":
        return [(round(rng.random(), 3), float(rng.random() < 0.3)) for _ in range(4000)]
    if kind == "rising":
        return [(round(x, 3), float(rng.random() < x * x)) for x in (rng.random() for _ in range(4000))]
    if kind == "falling":
        return [(i / 1000, float(rng.random() < 1 - i / 1000)) for i in range(1000)]
    return [(i / 100, float(k < i)) for i in range(100) for k in range(100)]  # strictly rising rates: nothing pools


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "strict"])
@pytest.mark.parametrize("slices", [1, 7, 40])
def test_blocks_by_pooling(spark, kind, slices):
    rows = samples(kind)
    df = spark.createDataFrame(rows + [(None, 1.0), (0.5, None)], "p double, y double")
    blocks = [(r.low, r.high, r.n, r.value) for r in C.fit_isotonic(df, "p", "y", slices).orderBy("low").collect()]
    want = pooled(rows)
    assert sum(b[2] for b in blocks) == len(rows)
    assert all(a[1] < b[0] and a[3] < b[3] for a, b in zip(blocks, blocks[1:]))
    for p, value in want.items():
        (own,) = [b for b in blocks if b[0] <= p <= b[1]]
        assert abs(own[3] - value) < 1e-12


def test_scores_between_and_beyond_the_blocks(spark):
    blocks = spark.createDataFrame([(0.2, 0.4, 5, 0.1), (0.6, 0.6, 3, 0.5), (0.8, 0.9, 9, 1.0)], "low double, high double, n long, value double")
    asked = [(0.1, 0.1), (0.2, 0.1), (0.3, 0.1), (0.4, 0.1), (0.5, 0.3), (0.6, 0.5), (0.7, 0.75), (0.85, 1 - C.SURE), (0.95, 1 - C.SURE), (None, None)]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(asked)] + [(99, 0.5)], "k int, p double")
    got = {r.k: r.calibrated for r in C.apply_isotonic(blocks, df, "p").collect()}
    assert len(got) == len(asked) + 1 and got[99] == got[4]
    for k, (_, want) in enumerate(asked):
        assert (got[k] is None) if want is None else abs(got[k] - want) < 1e-12


def test_no_rows(spark):
    none = spark.createDataFrame([], "p double, y double")
    blocks = C.fit_isotonic(none, "p", "y")
    assert blocks.count() == 0 and C.distinct_scores(none, "p") == 0
    passed = C.apply_isotonic(blocks, spark.createDataFrame([(0.25,)], "p double"), "p").first()
    assert passed.calibrated == 0.25


def test_few_distinct_scores_are_still_fitted(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.1, 1.0), (0.9, 1.0)], "p double, y double")
    assert [(r.low, r.value) for r in C.fit_isotonic(df, "p", "y").orderBy("low").collect()] == [(0.1, 0.5), (0.9, 1.0)]
    assert C.distinct_scores(df.withColumn("p", F.col("p") + 1e-6), "p") == 2
