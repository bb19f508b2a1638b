"""Fatigue, rest, travel and schedule density over game rows.

A game row is one appearance: a handful per (entity, day), so entity windows
stay as small as a playing calendar. All share one partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.columns import day_number
from fairline.functions.windows import START, ordered


def numbered(games: DataFrame, day: str) -> DataFrame:
    return games.withColumn("dn", day_number(day))


def fatigue_state(
    games: DataFrame, entity: str, tie: str, per_game: float = 0.02, double_header: float = 0.01, per_rest_day: float = 0.05,
) -> DataFrame:
    """Load that grows with back-to-back games and falls with rest, never below 0.

    The reflected walk ``x = max(0, x + d)`` equals the running sum minus its
    running minimum (bounded by 0), i.e. two windows and no recursion.
    """
    w = ordered([entity], ["dn", tie])
    upto = w.rowsBetween(START, 0)
    gap = F.col("dn") - F.lag("dn").over(w)
    step = F.when(gap.isNull(), 0.0).when(gap == 0, per_game + double_header).when(gap == 1, per_game).otherwise(
        -per_rest_day * (gap - 1))
    walked = games.withColumns({"_step": step, "_new": F.coalesce((gap > 1).cast("int"), F.lit(0))}).withColumns({
        "_sum": F.sum("_step").over(upto), "_run": F.sum("_new").over(upto)})
    load = F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(upto))
    in_run = ordered([entity, "_run"], ["dn", tie])
    out = walked.withColumns({
        "games_without_rest": F.row_number().over(in_run) - 1, "cumulative_fatigue": F.greatest(load, F.lit(0.0))})
    level = F.least(F.lit(1.0), F.col("cumulative_fatigue") / 0.2)
    return out.withColumns({
        "fatigue_level": level, "energy_reserves": F.greatest(F.lit(0.3), 1 - level),
        "recovery_status": F.greatest(F.lit(0.5), 1 - F.col("cumulative_fatigue")),
    }).drop("_step", "_new", "_sum", "_run")


def rest_deficit(games: DataFrame, entity: str, tie: str, wanted: float = 0.15) -> DataFrame:
    """Missing share of rest days over the last seven rows."""
    last7 = ordered([entity], ["dn", tie]).rowsBetween(-6, 0)
    n, span = F.count(F.lit(1)).over(last7), F.max("dn").over(last7) - F.min("dn").over(last7) + 1
    rested = F.greatest(F.lit(0.0), (span - n) / span)
    return games.withColumn("rest_deficit", F.when(n > 1, F.greatest(F.lit(0.0), wanted - rested)).otherwise(0.0))


def travel_features(
    games: DataFrame, entity: str, tie: str, place: str, offsets: DataFrame, offset: str = "utc_offset",
    home: str | None = None, default_offset: int = -5, threshold: int = 2,
) -> DataFrame:
    """Time-zone change, jet lag (worse eastwards), travel load, side change, remaining jet lag."""
    w = ordered([entity], ["dn", tie])
    placed = games.join(offsets.select(place, offset), place, "left").withColumn(
        offset, F.coalesce(F.col(offset), F.lit(default_offset)))
    gap = F.col("dn") - F.lag("dn").over(w)
    moved = (F.col(place) != F.lag(place).over(w)) & (gap <= 3)
    shift = F.col(offset) - F.lag(offset).over(w)
    staged = placed.withColumns({
        "_gap": gap, "_shift": shift, "_moved": F.coalesce(moved, F.lit(False)),
        **({"_flip": F.coalesce(F.col(home) != F.lag(home).over(w), F.lit(False))} if home else {}),
    })
    zones = F.when(F.col("_moved"), F.abs(F.col("_shift"))).otherwise(0)
    far = F.col("_moved") & (F.abs(F.col("_shift")) >= threshold)
    lag = F.when(far, F.abs(F.col("_shift")) / 3 * 0.05 * F.when(F.col("_shift") > 0, 1.5).otherwise(1.0)).otherwise(0.0)
    out = staged.withColumns({
        "timezone_change": zones, "jet_lag_factor": lag,
        "travel_fatigue": F.when(far, F.least(F.lit(0.1), F.abs(F.col("_shift")) * 0.02)).otherwise(0.0),
        "cross_country_travel": (far & (F.abs(F.col("_shift")) >= 3)).cast("int"),
        **({"home_away_transition": (F.col("_moved") & F.col("_flip")).cast("int")} if home else {}),
    })
    before = F.lag("jet_lag_factor").over(w)
    left = F.when((before > 0) & (F.col("_gap") >= 1), before * (1 - 0.5 * F.least(F.col("_gap"), F.lit(3)))).otherwise(0.0)
    return out.withColumn("time_zone_adjustment", left).drop("_gap", "_shift", "_moved", "_flip")


def consecutive_games(games: DataFrame, entity: str, tie: str) -> DataFrame:
    """W39 part: games in a row with a tolerance that grows by one day per step back.

    Going back ``k`` steps breaks at the first gap longer than ``k``. A gap
    after row ``j`` therefore ends the count of rows ``j + 1 .. j + gap - 1``;
    each gap is spread over the rows it can end (together no more rows than
    calendar days) and every row keeps its nearest one.
    """
    w = ordered([entity], ["dn", tie])
    ranked = games.select(
        "*", F.row_number().over(w).alias("_r"), (F.lead("dn").over(w) - F.col("dn")).alias("_gap"),
        F.count(F.lit(1)).over(Window.partitionBy(entity)).alias("_n"),
    )
    breaks = (
        ranked.where(F.col("_gap") >= 2)
        .select(entity, F.col("_r").alias("_at"), F.explode(F.sequence(
            F.col("_r") + 1, F.least(F.col("_r") + F.col("_gap") - 1, F.col("_n")))).alias("_r"))
        .groupBy(entity, "_r").agg(F.max("_at").alias("_at"))
    )
    joined = ranked.join(breaks, [entity, "_r"], "left")
    return joined.withColumn("consecutive_games", F.col("_r") - F.coalesce(F.col("_at"), F.lit(0))).drop("_r", "_gap", "_n", "_at")


def rest_patterns(games: DataFrame, entity: str, tie: str) -> DataFrame:
    """Days since rest, rest quality, games in a row, weekly density, time to the next game."""
    rows, days = ordered([entity], ["dn", tie]), ordered([entity], ["dn"])
    rested = F.max("dn").over(days.rangeBetween(START, -2))
    since = F.coalesce(F.col("dn") - rested - 1, F.row_number().over(rows) - 1)
    density = F.count(F.lit(1)).over(days.rangeBetween(-7, 0)) / 7.0
    out = consecutive_games(games, entity, tie).withColumns({
        "days_since_rest": since, "weekly_game_density": density,
        "recovery_time_available": F.least(F.lit(3.0), F.coalesce(F.lead("dn").over(rows) - F.col("dn"), F.lit(1)).cast("double")),
    })
    return out.withColumns({
        "rest_quality_score": F.greatest(F.lit(0.5), 1 - F.col("days_since_rest") * 0.05),
        "rest_vs_schedule": 4.5 / 7 - F.col("weekly_game_density"),
    })


def schedule_density(games: DataFrame, entity: str) -> DataFrame:
    """Games of the last 7 and 14 and the next 7 days (the schedule ahead is known), workloads."""
    w = ordered([entity], ["dn"])
    counts = games.withColumns({
        "games_last_7_days": F.count(F.lit(1)).over(w.rangeBetween(-7, 0)),
        "games_last_14_days": F.count(F.lit(1)).over(w.rangeBetween(-14, 0)),
        "games_next_7_days": F.count(F.lit(1)).over(w.rangeBetween(0, 7)),
    })
    return counts.withColumns({
        "schedule_intensity": (F.col("games_last_7_days") + F.col("games_next_7_days")) / 14.0,
        "upcoming_workload": F.col("games_next_7_days") / 7.0, "recent_workload": F.col("games_last_7_days") / 7.0,
    })
