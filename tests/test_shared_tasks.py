"""Queries whose tasks get a fixed number of lines: plans, and results against their SQL twins on rows made here."""

import os
import random
from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry
from check import canon
from fairline.bindings.plans import PITCHES, park_weather, stored_events
from fairline.functions import durable, parallel
from fairline.plans import features


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("lines"), random.Random(5)
    day = lambda: datetime(1998, 1, 1) + timedelta(days=rng.randrange(150))
    lines = [(
        rng.randrange(60), rng.randrange(9), 1 if rng.random() < 0.4 else rng.randrange(12), rng.randrange(1, 8), rng.choice([1.0, 2.5, 7.25, None]), 10.0 * rng.randrange(90),
        rng.choice([0.0, 0.05, 0.08, 0.1]), rng.choice(["A", "R", "N"]), rng.choice(["F", "O"]), day(),
    ) for _ in range(2000)]
    made = {
        "lineitem": (lines + lines[:200], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                     "l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "part": ([(k, f"kind {k % 3}", k) for k in range(8)], "p_partkey long, p_type string, p_size int"),
        "orders": ([(k, k % 40) for k in range(55)] + [(3, 7)], "o_orderkey long, o_custkey long"),
        "customer": ([(k, k % 25) for k in range(38)], "c_custkey long, c_nationkey int"),
        "supplier": ([(k, k % 25) for k in range(11)], "s_suppkey long, s_nationkey int"),
    }
    for name, (rows, kind) in made.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["j6_lookback_range_join", "j16_join_pitch_slg"])
def test_tasks_get_a_fixed_number_of_lines(spark, tables, monkeypatch, name):
    monkeypatch.setattr(parallel, "ROWS_OF_A_TASK", 300)
    df = entry.queries()[name](spark, tables)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    con = duckdb.connect()
    for table in ("lineitem", "part", "orders", "customer", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tables}/{table}.parquet/*.parquet')")
    found = con.execute(entry.oracle_sql()[name])
    want = canon(found.fetchall(), [d[0] for d in found.description])
    assert got == want and len(got[0]) > 100
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # before: joined to tasks of a size in bytes, so a task's hash tables and sorts grew with the input
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 1


def test_weather_table_has_all_columns_it_is_made_of(spark, tables):
    df = entry.queries()["s3_read_weather_csv"](spark, tables)  # before: an error, as the stored lines had no park, game and inning
    got = canon([tuple(r) for r in df.collect()], df.columns)
    con = duckdb.connect()
    for table in ("lineitem", "part", "orders", "customer", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tables}/{table}.parquet/*.parquet')")
    found = con.execute(entry.oracle_sql()["s3_read_weather_csv"])
    assert got == canon(found.fetchall(), [d[0] for d in found.description]) and len(got[0]) > 100


def test_feature_table_leaves_only_the_wide_table_on_disk(spark, tables):
    events, folder, held = stored_events(spark, tables), durable.shared_folder(spark), spark.conf.get(durable._CLEANUP, None)
    before = set(os.listdir(folder))
    table = features.build_feature_table(events, PITCHES, park_weather(events))
    left = [spark.read.parquet(f"{folder}/{name}").columns for name in sorted(set(os.listdir(folder)) - before)]
    # before: also the day tables, the spine and all blocks
    assert len(left) <= 3 and sum("roll10_pa" in columns for columns in left) == 1 and not any(set(columns) <= {*features.GAME_KEYS, "opp_starter"} for columns in left)
    assert spark.conf.get(durable._CLEANUP, None) == held
    assert table.df.count() == events.groupBy(*features.GAME_KEYS).count().count() > 100


def test_shuffle_files_go_with_their_query(spark):
    def files():
        local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {b.name() for b in (lambda found: [found.apply(k) for k in range(found.size())])(local.getAllBlocks().toList()) if b.isShuffle()}

    before = files()
    with durable.shuffles_removed(spark):
        assert spark.range(1000).repartition(3, "id").groupBy("id").count().count() == 1000
    assert files() <= before
