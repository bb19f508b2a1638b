"""Range-sliced running totals, ranks and quantiles against plain Python, with one group holding most rows."""

import os
import random
import statistics

import numpy as np

from fairline.functions import durable
from fairline.functions import ordering as O


def rows(n=600):
    random.seed(1)
    return [("hot" if i % 10 else f"g{i % 30}", i, float(random.randint(0, 40))) for i in range(n)]


def test_running_totals(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, k bigint, v double")
    got = {r.k: r.v_before for r in O.running_totals(df, ["g"], ["k"], ["v"], slices=7).collect()}
    sums = {}
    for g, k, v in data:
        assert got[k] == sums.get(g, 0.0)
        sums[g] = sums.get(g, 0.0) + v


def test_average_rank_handles_ties(spark):
    data = rows(200)
    df = spark.createDataFrame(data, "g string, k bigint, v double")
    values = sorted(v for _, _, v in data)
    for r in O.average_rank(df, "v").collect():
        positions = [i + 1 for i, v in enumerate(values) if v == r.v]
        assert r.avg_rank == statistics.mean(positions) and r.group_n == 200


def test_exact_quantiles(spark):
    df = spark.createDataFrame([(float(i * i % 97), None if i % 5 == 0 else float(i)) for i in range(150)], "a double, b double")
    want_a = [i * i % 97 for i in range(150)]
    want_b = [i for i in range(150) if i % 5]
    for r in O.exact_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        assert abs(r.value - np.quantile(want_a if r.feature == "a" else want_b, r.fraction)) < 1e-9


def test_written_cuts_go_with_their_scope(spark):
    with durable.cuts_removed(spark):
        cut = durable.materialise(spark.range(5))
        files = [path.removeprefix("file:") for path in cut.inputFiles()]
        assert cut.count() == 5 and all(os.path.exists(path) for path in files)
    assert files and not any(os.path.exists(path) for path in files)
