"""The feature table: reads of the events, groups and order of its columns, and no look ahead."""

import pytest
from pyspark.sql import functions as F

from fairline.bindings.plans import PITCHES, park_weather, stored_events
from fairline.operators import quality
from fairline.plans import day_tables, features

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return stored_events(spark, SF)


def test_finished_table(spark, events):
    table = features.build_feature_table(events, PITCHES, park_weather(events))
    done = features.final_table(table)
    assert done.columns[:3] == ["date", "season", "game_pk"] and len(set(done.columns)) == len(done.columns)
    assert list(table.groups) == features.GROUPS
    at = [done.columns.index(table.groups[name][0]) for name in features.GROUPS]
    assert at == sorted(at)
    for wanted in ("roll10_launch_speed", "R_hr_rate10", "p_roll10_vel", "mix_EC", "exp_slg_vs_mix", "vs_similar_hand_hr_rate", "clutch_hr_rate", "weather_favorability_index",
                   "power_form_hr_rate", "momentum_score", "mental_toughness", "batter_park_hr_rate_boost", "park_weather_hr_multiplier", "jet_lag_factor", "games_next_7_days",
                   "overall_performance_multiplier"):
        assert wanted in done.columns, wanted
    assert done.count() == events.groupBy(*features.GAME_KEYS).count().count()
    verdict = {r["check"]: r["passed"] for r in features.checked_feature_table(table).collect()}
    assert verdict
    with pytest.raises(ValueError, match="missing required"):
        features.final_table(features.FeatureTable(table.df.drop("hit_hr"), table.groups))


def test_fitted_table_does_not_look_ahead(spark, events):
    """All rows up to a day stay what they are when later events are removed (statistics fitted before that day)."""
    cut = events.agg(F.percentile_approx(F.unix_date("date"), 0.5).alias("d")).select(F.date_from_unix_date("d").alias("d")).first()["d"].isoformat()

    def build(rows):
        out = features.build_feature_table(rows, PITCHES, fit_before=cut).df.drop("games_next_7_days", "schedule_intensity", "upcoming_workload", "recovery_time_available")
        out = out.drop(*[c for c in out.columns if "rest_workload" in c or "physical_condition" in c or c in ("mind_body_synergy", "rest_performance_synergy")])
        return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    assert quality.leak_check(build, events, "date", cut).count() == 0


def test_place_in_game_is_ordered_and_bounded(spark):
    rows = [(1, 1, 1), (1, 1, 2), (1, 2, 0), (2, 0, 0), (9, 70, 400), (None, 1, 1)]
    df = spark.createDataFrame(rows, "inning int, at_bat_number int, pitch_number int").select(day_tables.place_in_game().alias("p"))
    places = [r.p for r in df.collect()]
    assert places[:5] == sorted(places[:5]) and len(set(places)) == 6 and places[5] is None
    big = spark.createDataFrame([(5000, 1, 1)], "inning int, at_bat_number int, pitch_number int").select(day_tables.place_in_game().alias("p"))
    with pytest.raises(Exception, match="out of range"):
        big.collect()


def test_only_the_day_tables_asked_for_are_built(spark):
    rows = spark.sql("""SELECT DATE '2024-04-01' AS date, 1L AS game_pk, 'BOS' AS home_team, 'NYY' AS away_team, 'BOS' AS bat_team, 'NYY' AS def_team, 7L AS batter, p AS pitcher,
      'R' AS p_throws, 'FF' AS pitch_type, 95.0D AS release_speed, 'home_run' AS events, 100.0D AS launch_speed, 30.0D AS launch_angle, 1 AS is_pa, 1 AS is_hr FROM VALUES (8L), (8L), (9L) AS t(p)""")
    days = day_tables.day_tables(rows, ["launch_speed", "launch_angle"], ["FF"], {}, wanted=("pair", "profile"))
    assert set(days) == {"pair", "profile"}
    assert sorted((r.batter, r.pitcher, r.n, r.hr, r.launch_angle_sum) for r in days["pair"].collect()) == [(7, 8, 2, 2, 60.0), (7, 9, 1, 1, 30.0)]
    assert sorted((r.pitcher, r.hand, r.past_n) for r in days["profile"].collect()) == [(8, "R", 2), (9, "R", 1)]
