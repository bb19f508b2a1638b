"""Split properties, a separable fit, leak checks of point-in-time features, and small join edges."""

import random

import pytest
from pyspark.sql import functions as F

from fairline.bindings.frames import ev, ev_day
from fairline.bindings.streaks import game_rows
from fairline.operators import clean, evaluate, form, join, model, quality, rolling, schedule, streak

SF = "/root/testdata/sf0.001"
CUT = "2024-01-15"


@pytest.mark.parametrize("name", ["rolling", "form", "streak", "indicators", "fatigue"])
def test_features_do_not_see_later_rows(spark, name):
    builds = {
        "rolling": (lambda d: rolling.rolling_days_lagged(d, ["user_id"], "dn", ["hit"], ["x"]), ev_day(spark, SF)),
        "form": (lambda d: form.trend_slopes(form.decayed_power_form(form.form_days(d, "user_id", "day", "att", "hit", "x", "angle"), "user_id"), "user_id"), ev(spark, SF)),
        "streak": (lambda d: streak.streak_feature_set(d, "user_id", "day", "half", "hit"), game_rows(spark, SF)),
        "indicators": (lambda d: form.recent_n_indicators(d, "user_id", "day", ["ts", "event_id"], "hit", "x"), ev(spark, SF)),
        "fatigue": (lambda d: schedule.fatigue_state(schedule.numbered(d, "day"), "user_id", "half"), game_rows(spark, SF)),
    }
    build, rows = builds[name]

    def rounded(df):
        out = build(df)
        return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    assert quality.leak_check(rounded, rows, "day", CUT).count() == 0


def test_stratified_split_keeps_class_shares(spark):
    df = spark.range(20000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    split = evaluate.stratified_split(df, "label", ["id"])
    shares = {(r.label, r.split): r.n for r in split.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    for label, size in ((0, 18000), (1, 2000)):
        assert abs(shares[(label, "train")] / size - 0.7) < 0.03 and abs(shares[(label, "test")] / size - 0.15) < 0.03
    assert split.exceptAll(evaluate.stratified_split(df.repartition(3), "label", ["id"])).count() == 0


def test_separable_fit_and_monotone_calibration(spark):
    random.seed(3)
    rows = [(float(random.gauss(i % 2, 0.4)), None if i % 11 == 0 else float(i % 7), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    fitted = model.train_model("logistic", df, ["a", "b"], "label")
    scored = model.predict(fitted, df, ["a", "b"])
    assert evaluate.binary_metrics(scored, "probability_1", "label").first().roc_auc > 0.9
    calibrated = model.apply_isotonic(model.fit_isotonic(scored, "probability_1", "label"), scored, "probability_1")
    values = [r.calibrated for r in calibrated.orderBy("probability_1").collect()]
    assert all(x <= y + 1e-12 for x, y in zip(values, values[1:])) and 0 < values[0] and values[-1] < 1
    flat = model.fit_isotonic(scored.withColumn("probability_1", F.lit(0.5)), "probability_1", "label").collect()
    assert [(r.low, r.high, r.n, r.value) for r in flat] == [(0.5, 0.5, 400, 0.5)]


def test_missing_columns_fail_while_planning(spark):
    with pytest.raises(ValueError, match="missing required"):
        clean.require_columns(spark.range(1), ["id", "other"])


def test_name_containment_is_literal_and_can_fold_accents(spark):
    names = spark.createDataFrame([("José Ramírez Jr.",), ("J. D. Martinez",), ("JxD. Martinez",)], "name string")
    targets = spark.createDataFrame([("Jose Ramirez",), ("J. D. Mart",), ("",)], "target string")
    plain = {(r.target, r.name) for r in join.match_names_contains(names, "name", targets, "target").collect()}
    assert plain == {("J. D. Mart", "J. D. Martinez")}
    folded = {(r.target, r.name) for r in join.match_names_contains(names, "name", targets, "target", accents=True).collect()}
    assert ("Jose Ramirez", "José Ramírez Jr.") in folded


def test_imputation_rules(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, float("inf"), None), (3, float("nan"), None), (4, 3.0, None)], "id int, a double, b double")
    rows = clean.impute_median(df, exclude=("id",)).orderBy("id").collect()
    assert [r.a for r in rows] == [1.0, 2.0, 2.0, 3.0] and all(r.b == 0.0 for r in rows)


def test_similar_history_shuffles_the_entity_once(spark):
    """Against all earlier days one by one, with keys, days and profiles that are missing."""
    random.seed(3)
    days = [None, *[f"2024-04-{d:02d}" for d in range(1, 9)]]
    pairs = [(random.choice(["a", "b", None]), random.choice([1, 2, 3, 9, None]), random.choice(days), random.randint(0, 4), random.randint(0, 2)) for _ in range(150)]
    games = [(e, o, d) for e in ("a", "b", None) for o in (1, 2, 3, 9, None) for d in days]
    shapes = {1: ("R", "high"), 2: ("R", None), 3: (None, "high")}
    p = spark.createDataFrame(pairs, "ent string, opp long, day string, pa long, hr long").withColumn("day", F.to_date("day"))
    g = spark.createDataFrame(games, "ent string, opp long, day string").withColumn("day", F.to_date("day"))
    s = spark.createDataFrame([(o, *v) for o, v in shapes.items()], "opp long, handedness string, velocity_tier string")
    out = join.similar_group_history(g, p, s, "ent", "opp", "day")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2

    def before(e, o, d, i, m):
        mine = shapes.get(o, (None, None))[i]
        if e is None or d is None or mine is None:
            return 0
        return sum(r[m] for r in pairs if r[0] == e and r[1] in shapes and r[1] != o and shapes[r[1]][i] == mine and (r[2] is None or r[2] < d))

    got = {(r.ent, r.opp, str(r.day) if r.day else None): (r.vs_similar_hand_pa, r.vs_similar_hand_hr, r.vs_similar_velocity_pa, r.vs_similar_velocity_hr) for r in out.collect()}
    assert got == {(e, o, d): tuple(before(e, o, d, i, m) for i in (0, 1) for m in (3, 4)) for e, o, d in games}


def test_training_prepares_rows_once_for_all_kinds(spark, monkeypatch):
    calls, prepare = [], model.prepare_features
    monkeypatch.setattr(model, "prepare_features", lambda features: calls.append(1) or prepare(features))
    rows = spark.createDataFrame([(float(i % 7), None if i % 5 == 0 else float(i), int(i % 7 > 3)) for i in range(120)], "a double, b double, label int")
    small = model.ModelSettings(forest_trees=3, forest_depth=2, boost_rounds=3, boost_depth=2)
    models = model.train_models(rows, ["a", "b"], "label", settings=small)
    assert len(calls) == 1 and set(models) == {"logistic", "forest", "boosted"}
    for fitted in models.values():
        assert model.predict(fitted, rows, ["a", "b"]).where("(probability_1 > 0.5) = (label = 1)").count() == 120


def test_store_batches_read_written_lines(spark, monkeypatch):
    from fairline.bindings import payloads
    from fairline.bindings.registry import QUERIES
    plans, upsert = [], payloads.K.upsert_matchup_tables
    monkeypatch.setattr(payloads.K, "upsert_matchup_tables", lambda s, path, increment, *rest: plans.append(increment) or upsert(s, path, increment, *rest))
    assert QUERIES["s10_upsert_matchup_tables"](spark, SF).count() > 0
    assert plans and all("Join" not in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)


def test_ablation_prepares_rows_once(spark, monkeypatch):
    rng, weighted = random.Random(8), []
    made = [(rng.random(), rng.choice([1.0, 2.0, None, float("inf")]), float(k % 7), int(k % 7 + 3 * rng.random() > 5)) for k in range(600)]
    rows = spark.createDataFrame(made, "a double, b double, c double, y int").coalesce(1)
    train, test, settings = rows.where("a < 0.8"), rows.where("a >= 0.8"), model.ModelSettings(boost_rounds=3, boost_depth=2, boost_rate=0.3)
    monkeypatch.setattr(model, "balanced_weights", lambda df, label, f=model.balanced_weights: weighted.append(label) or f(df, label))
    got = model.ablation_experiments(train, test, [("first", ["a", "b"]), ("second", ["c", "missing"])], "y", settings=settings)[0].orderBy("step").collect()
    assert weighted == ["y"]  # before: once for each experiment, as all else that prepares the rows
    assert [(r["experiment_name"], r["feature_count"]) for r in got][:2] == [("first", 2), ("second", 3)] and got[2]["experiment_name"] == "top_features"
    for r, columns in zip(got, (["a", "b"], ["a", "b", "c"])):
        m = evaluate.binary_metrics(model.predict(model.train_model("boosted", train, columns, "y", settings), test, columns), "probability_1", "y").first()
        assert [r[k] for k in model.METRICS] == pytest.approx([m[k] for k in model.METRICS])
