"""The feature table from day tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.functions.columns import day_number
from fairline.functions.durable import cuts_removed, materialise, shuffles_removed
from fairline.functions.parallel import written_side_by_side
from fairline.operators import aggregate as A
from fairline.operators import clean, form, interaction, join, physics, rolling, schedule, streak
from fairline.operators.quality import validate_dataset
from fairline.plans.day_tables import day_tables, mean_of, starters_of
from fairline.schema import STADIUM_OFFSET

GAME_KEYS = ["date", "game_pk", "batter", "home_team", "away_team", "bat_team"]
BAT_TRACKING = ["bat_speed", "attack_angle", "attack_direction", "swing_path_tilt"]
LAUNCH = ["launch_speed", "launch_angle"]
BASES = ["on_1b", "on_2b", "on_3b"]
ORDER = ["inning", "at_bat_number", "pitch_number"]
RATE_COLUMNS = ["roll10_hr_rate", "roll30d_hr_rate", "p_roll10_hr_rate", "p_roll30d_hr_rate", "power_form_hr_rate"]
#: Feature groups in the order of the finished table.
GROUPS = ["rolling", "handedness", "pitcher", "mix", "matchup", "situational", "weather", "recent_form", "streak_momentum", "ballpark",
          "temporal_fatigue", "interactions"]
#: Columns of the finished table before its features.
ABOUT = ["date", "season", "game_pk", "batter", "batter_name", "bat_team", "home_team", "away_team", "stadium", "park_factor", "opp_team", "opp_starter",
         "home_runs", "hit_hr"]


@dataclass
class FeatureTable:
    """The table and, per feature group, the columns the group added."""

    df: DataFrame
    groups: dict[str, list[str]]


def _rates() -> list[A.Rate]:
    """All situational rates; the overall rate, which two families start from, once."""
    return [*A.situation_rates(BASES, "score_diff"), *A.pressure_rates("inning", "score_diff", BASES), *A.inning_rates("inning", "at_bat_number"),
            *[r for r in A.leverage_rates("_leverage") if r.name != "overall_hr_rate"], *A.count_rates("balls", "strikes")]


def _shared_parts(rates: list[A.Rate]) -> tuple[dict, dict[str, str]]:
    """Event-grain columns of the rates, equal ones once, and the column of each part."""
    columns, place, known = {}, {}, {}
    for name, column in A.rate_parts(rates).items():
        same = known.setdefault(str(column), name)
        columns.setdefault(same, column)
        place[name] = same
    return columns, place


def prepared_events(events: DataFrame) -> DataFrame:
    """Event rows with hand, defending team, score difference and leverage."""
    batting_home = F.col("bat_team") == F.col("home_team")
    gap = F.col("post_home_score") - F.col("post_away_score")
    return events.withColumns({
        "p_throws": F.coalesce("p_throws", F.lit("R")), "def_team": F.when(batting_home, F.col("away_team")).otherwise(F.col("home_team")),
        "score_diff": F.when(batting_home, gap).otherwise(-gap),
    }).withColumn("_leverage", A.leverage_score("inning", "score_diff", BASES))


def rolling_block(batters: DataFrame, means: list[str]) -> DataFrame:
    """W1-W3 per (batter, day)."""
    daily = batters.select("batter", "date", F.unix_date("date").alias("dn"), "pa", "hr", *[mean_of(m).alias(m) for m in means])
    rolled = rolling.rolling_rows_lagged(daily, ["batter"], ["dn"], ["pa", "hr"], means)
    rolled = rolling.rolling_days_lagged(rolled, ["batter"], "dn", ["pa", "hr"], means)
    rates = {"roll10_hr_rate": ("roll10_hr", "roll10_pa"), "roll30d_hr_rate": ("roll30d_hr", "roll30d_pa")}
    return rolling.rate_and_flags(rolled, rates, "roll10_launch_speed", "roll10_launch_angle").drop("pa", "hr", "dn", *means)


def hand_block(hands: DataFrame) -> DataFrame:
    """A2, W4 per (batter, day)."""
    daily = hands.select("batter", "hand", "date", "pa", "hr", mean_of("launch_speed").alias("ev"), mean_of("launch_angle").alias("la"))
    return rolling.split_rolling_pivot(daily, "batter", "hand", ["R", "L"], "date", ["pa", "hr"], ["ev", "la"])


def pitcher_block(pitchers: DataFrame) -> DataFrame:
    """A3, W5 per (pitcher, day)."""
    faced = pitchers.select("pitcher", "date", F.col("hr").alias("hr_allowed"), F.col("pa").alias("pa_faced"), mean_of("launch_speed").alias("ev_allowed"),
                            mean_of("release_speed").alias("vel"))
    return rolling.opponent_rolling(faced, "pitcher", "date").drop("hr_allowed", "pa_faced", "ev_allowed", "vel")


def mix_block(pitchers: DataFrame, pitch_types: list[str]) -> DataFrame:
    """A4, W6 per (pitcher, day)."""
    return rolling.rolling_mix_fractions(pitchers.select("pitcher", "date", *[f"n_{k}" for k in pitch_types]), "pitcher", "date", {k: f"n_{k}" for k in pitch_types})


def slg_block(batters: DataFrame, pitch_types: list[str]) -> DataFrame:
    """A5, W7 per (batter, day) with typed rows."""
    return rolling.rolling_slg_wide(batters.where("pitches > 0"), "batter", "date", pitch_types)


def form_block(batters: DataFrame) -> DataFrame:
    """W12-W14, W16 per (batter, day)."""
    days = batters.select(
        "batter", "date", "n", "pa", "hr", F.col("launch_speed_sum").alias("ev"), F.col("launch_speed_n").alias("ev_n"), "hard", "barrel",
        F.col("launch_angle_sum").alias("la"), "la2", F.col("launch_angle_n").alias("la_n"), "sweet", "line", day_number("date").alias("dn"))
    shaped = form.decayed_contact_form(form.decayed_power_form(days, "batter"), "batter")
    shaped = form.trend_slopes(form.discipline_form(shaped, "batter"), "batter")
    return shaped.drop(*[c for c in days.columns if c not in ("batter", "date")])


def profiles_of(hands: DataFrame) -> DataFrame:
    """A7 from sums per (pitcher, hand): mean speed, most frequent hand (lowest on ties), speed tier."""
    raw = hands.where("past_n > 0").groupBy("pitcher").agg(
        (F.sum("past_speed_sum") / F.nullif(F.sum("past_speed_n"), F.lit(0))).alias("speed"),
        F.min_by("hand", F.struct((-F.col("past_n")).alias("n"), "hand")).alias("handedness"))
    speed = F.coalesce("speed", F.lit(92.0))
    return raw.select("pitcher", speed.alias("avg_velocity"), F.coalesce("handedness", F.lit("R")).alias("handedness"), A.velocity_tier(speed).alias("velocity_tier"))


def matchup_block(spine: DataFrame, pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """J5, J7, W9, W10 per (batter, opposing starter, day)."""
    asked = spine.select("batter", "opp_starter", "date").distinct()
    sums = pairs.select(
        "batter", F.col("pitcher").alias("opp_starter"), "date", "pa", "hr", F.col("launch_speed_sum").alias("ev_sum"), F.col("launch_speed_n").alias("ev_n"),
        F.col("launch_angle_sum").alias("la_sum"), F.col("launch_angle_n").alias("la_n"))
    known = rolling.matchup_features(asked, sums, ["batter", "opp_starter"], "date")
    return join.similar_group_history(known, sums, profiles.withColumnRenamed("pitcher", "opp_starter"), "batter", "opp_starter", "date")


def schedule_block(spine: DataFrame) -> DataFrame:
    """W36-W40 per game row."""
    offsets = F.broadcast(spine.sparkSession.createDataFrame(list(STADIUM_OFFSET.items()), "stadium string, utc_offset int"))
    rows = spine.select(*GAME_KEYS, "stadium", (F.col("bat_team") == F.col("home_team")).alias("_home"))
    timed = schedule.rest_deficit(schedule.fatigue_state(schedule.numbered(rows, "date"), "batter", "game_pk"), "batter", "game_pk")
    timed = schedule.travel_features(timed, "batter", "game_pk", "stadium", offsets, home="_home")
    return schedule.schedule_density(schedule.rest_patterns(timed, "batter", "game_pk"), "batter").drop("dn", "_home", "utc_offset", "stadium")


def lift_block(spine: DataFrame) -> DataFrame:
    """A18 per (batter, stadium, day)."""
    return A.entity_group_lift(spine, "batter", "stadium", "date", "hit_hr").withColumnsRenamed(
        {"rate_boost": "batter_park_hr_rate_boost", "comfort_factor": "batter_park_comfort_factor"})


def _wide_table(events: DataFrame, pitch_types: list[str], weather: DataFrame | None, fit_before: str | None) -> tuple[DataFrame, dict[str, list[str]]]:
    """All feature groups but the interactions, written, and the columns of each."""
    spark, groups, key = events.sparkSession, {}, ["batter", "date"]
    rows = prepared_events(events)
    means = [*LAUNCH, *[c for c in BAT_TRACKING if c in events.columns]]
    rates = _rates()
    parts, place = _shared_parts(rates)
    days = day_tables(rows, means, pitch_types, parts, fit_before)
    games = days["game"].select(*GAME_KEYS, "pa", "hr", *[mean_of(m).alias(m) for m in means], (F.col("hr") > 0).cast("int").alias("hit_hr"))
    games = clean.derive_opponent(clean.attach_park(games), "home_team", "away_team", "bat_team")
    spine = materialise(join.join_starters(games, starters_of(days["starter"]), "game_pk", "opp_team", "def_team"))

    derived = {n: f() for n, f in {**A.PRESSURE_INDEX, **A.LEVERAGE_RATIO}.items()}
    starter = {"pitcher": "opp_starter"}
    def added(name: str, before: DataFrame, after: DataFrame, more: list[str]) -> DataFrame:
        groups[name] = [c for c in after.columns if c not in before.columns] + more
        return after

    # the wide table is joined in this order: odd keys while it is narrow, then all blocks of (batter, date) in one place
    plans = {
        ("lift", ("batter", "stadium", "date")): lambda: lift_block(spine),
        ("pitcher", ("opp_starter", "date")): lambda: pitcher_block(days["pitcher"]).withColumnsRenamed(starter),
        ("mix", ("opp_starter", "date")): lambda: mix_block(days["pitcher"], pitch_types).withColumnsRenamed(starter),
        ("matchup", ("batter", "opp_starter", "date")): lambda: matchup_block(spine, days["pair"], profiles_of(days["profile"])),
        ("schedule", tuple(GAME_KEYS)): lambda: schedule_block(spine),
        ("rolling", tuple(key)): lambda: rolling_block(days["batter"], means),
        ("handedness", tuple(key)): lambda: hand_block(days["hand"]),
        ("slg", tuple(key)): lambda: slg_block(days["batter"], pitch_types),
        ("situational", tuple(key)): lambda: A.rates_before(days["batter"], "batter", "date", rates, derived, place),
        ("recent_form", tuple(key)): lambda: form_block(days["batter"]),
        ("recent_form", ("batter", "date", "")): lambda: form.recent_n_indicators(
            rows.where("is_pa = 1"), "batter", "date", [*ORDER, "game_pk"], "is_hr", "launch_speed"),
        ("streak_momentum", tuple(key)): lambda: streak.streak_feature_set(spine, "batter", "date", "game_pk", "hit_hr"),
    }
    blocks = written_side_by_side(plans)
    wide = spine
    if weather is not None:
        wide = added("weather", wide, join.join_weather(wide, weather), [])
    narrow = True
    for (name, on), block in blocks.items():
        on = [c for c in on if c]
        if narrow and on == key:  # the shuffles of the odd keys go before the wide ones come
            wide, narrow = materialise(wide), False
        groups[name] = groups.get(name, []) + [c for c in block.columns if c not in on]
        wide = wide.join(block, on, "left")
    if weather is not None:  # made of the row alone, so it isn't shuffled
        before, wide = wide, physics.weather_indices(physics.wind_features(physics.air_density_features(physics.weather_factors(wide))))
        groups["weather"] += [c for c in wide.columns if c not in before.columns]
    slg, timed, lift = (groups.pop(c) for c in ("slg", "schedule", "lift"))
    wide = wide.withColumn("exp_slg_vs_mix", rolling.mix_value(pitch_types)).drop(*slg)
    groups["matchup"].insert(0, "exp_slg_vs_mix")

    dims = physics.park_table(spark)
    parked = physics.attach_dimensions(wide, dims)
    for step in (physics.park_dimension_features, physics.park_carry_features, physics.park_direction_features, physics.park_calendar_effects, physics.park_context):
        parked = step(parked)
    if weather is not None:
        parked = physics.park_weather_interaction(parked)
    wide = added("ballpark", wide, parked.drop(*[c for c in dims.columns if c != "stadium"]), lift)
    hours = wide.withColumn("game_hour", clean.infer_game_hour(F.col("date")))
    wide = added("temporal_fatigue", wide, physics.performance_timing(physics.season_energy(physics.circadian_features(hours))), timed)

    return materialise(wide, kept=True), groups


def build_feature_table(
    events: DataFrame, pitch_types: list[str], weather: DataFrame | None = None, impute: str | None = None,
    fit_before: str | None = None, fitted: DataFrame | None = None,
) -> FeatureTable:
    """One row per (batter, game) with all point-in-time features.

    ``events`` are cleaned event rows (see ``read_pitch_events``). They are read three times: twice for the day tables
    and once for the newest attempts of each day. Every block is a small plan over day tables, written beside
    the others; the wide table is one chain of equi joins of written blocks.

    Pitcher profiles and the table-wide statistics of the interaction features come from rows before the date
    ``fit_before`` (or from ``fitted``, the statistics row of a training table); without either they describe the whole
    table, which is right for a closed history only. Bat-tracking columns are averaged and rolled where events have them.
    """
    spark = events.sparkSession
    # once the wide table is written, the shuffles and tables it was made of are not needed on disk
    with shuffles_removed(spark), cuts_removed(spark):
        wide, groups = _wide_table(events, pitch_types, weather, fit_before)
    if fitted is None and fit_before is not None:
        fitted = interaction.global_statistics(wide.where(F.col("date") < F.lit(fit_before).cast("date")))
    out = interaction.feature_interactions(wide, fitted)
    groups["interactions"] = [c for c in out.columns if c not in wide.columns]
    out = clean.clip_rate_columns(out, RATE_COLUMNS)
    if impute:
        numeric = [c for cols in groups.values() for c in cols if dict(out.dtypes)[c] in ("double", "bigint", "int")]
        out = clean.impute_median(out, numeric, approximate=impute == "approximate")
    return FeatureTable(out, {name: groups[name] for name in GROUPS if name in groups})


def final_table(table: FeatureTable, names: DataFrame | None = None) -> DataFrame:
    """The finished table: what a row is about, then the feature groups in their order.

    ``names`` is a register (``key``, ``first``, ``last``) for ``batter_name``. A table without a required column raises.
    """
    df = table.df.withColumns({"season": clean.season_of(F.col("date")), "home_runs": F.col("hr")})
    if names is not None:
        df = join.join_names(df, names, "batter", "key", "first", "last", "batter_name")
    clean.require_columns(df, ["date", "batter", "home_runs", "hit_hr"])
    features = [c for name in GROUPS for c in table.groups.get(name, [])]
    return df.select(*[c for c in ABOUT if c in df.columns], *features)


def checked_feature_table(table: FeatureTable) -> DataFrame:
    """D1 rows for a finished table."""
    return validate_dataset(table.df, GAME_KEYS, "hit_hr", "date")
