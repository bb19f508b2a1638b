"""Two scans of the events, many grains.

Batters' days are wide, so they are one plain aggregation. All other grains need a dozen sums each: every event row is
tagged with the grains it counts for, each with its own keys and its own measures in common slots, and one aggregation
gives them all, written as one table with a folder for each grain. Windows read these day tables, never the events.
Only the tables a caller names are built: rows are tagged for, and carry keys and slots of, those grains alone.
Everything is additive (the starter's place a minimum), so partial aggregation shrinks hot players and days before the
shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions.columns import first_matching
from fairline.functions.parallel import written_side_by_side
from fairline.operators import aggregate as A

KEYS = ["date", "game_pk", "home_team", "away_team", "bat_team", "def_team", "batter", "pitcher", "hand"]
#: Bits of inning, turn and pitch in an event's place within its game.
PLACE = {"inning": 12, "at_bat_number": 20, "pitch_number": 31}


@dataclass(frozen=True)
class Grain:
    keys: list[str]
    measures: list[str]


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def mean_of(column: str) -> Column:
    """The mean that a day table's sum and count stand for."""
    return F.col(f"{column}_sum") / F.nullif(F.col(f"{column}_n"), F.lit(0))


def event_measures(means: list[str], pitch_types: list[str]) -> dict[str, Column]:
    """What every grain is added up from, at event grain."""
    c = F.col
    bases = first_matching([(c("events") == k, F.lit(v)) for k, v in A.BASES.items()], F.lit(0))
    out = {"n": F.lit(1).cast("bigint"), "pa": c("is_pa").cast("bigint"), "hr": c("is_hr").cast("bigint"), "pitches": _flag(c("pitch_type").isNotNull())}
    for m in [*means, "release_speed"]:
        out |= {f"{m}_sum": c(m).cast("double"), f"{m}_n": _flag(c(m).isNotNull())}
    for k in pitch_types:
        own = c("pitch_type") == k
        out |= {f"n_{k}": _flag(own), f"tb_{k}": F.when(own, bases).otherwise(0).cast("bigint"), f"ab_{k}": _flag(own & c("events").isin(A.AT_BAT_WIDE))}
    speed, angle = c("launch_speed"), c("launch_angle")
    return out | {
        "hard": _flag(speed >= 95), "barrel": _flag((speed >= 98) & angle.between(25, 35)), "la2": angle.cast("double") * angle,
        "sweet": _flag(angle.between(8, 32)), "line": _flag(angle.between(10, 25)),
    }


def place_in_game() -> Column:
    """Inning, turn and pitch as one ordered number; a value that doesn't fit fails the query."""
    fits, packed = F.lit(True), F.lit(0).cast("bigint")
    for column, bits in PLACE.items():
        value = F.col(column).cast("bigint")
        fits = fits & value.between(0, (1 << bits) - 1)
        packed = packed * (1 << bits) + value
    known = F.col("inning").isNotNull() & F.col("at_bat_number").isNotNull() & F.col("pitch_number").isNotNull()
    return F.when(known, F.when(fits, packed).otherwise(F.raise_error(F.lit("inning, at_bat_number or pitch_number is out of range"))))


def grains_of(means: list[str], pitch_types: list[str]) -> dict[str, Grain]:
    def moments(columns: list[str]) -> list[str]:
        return [f"{m}_{s}" for m in columns for s in ("sum", "n")]

    launch = ["launch_speed", "launch_angle"]
    return {
        "game": Grain(["date", "game_pk", "home_team", "away_team", "bat_team", "batter"], ["pa", "hr", *moments(means)]),
        "hand": Grain(["date", "batter", "hand"], ["pa", "hr", *moments(launch)]),
        "pitcher": Grain(["date", "pitcher"], ["pa", "hr", "pitches", *moments(["launch_speed", "release_speed"]), *[f"n_{k}" for k in pitch_types]]),
        "pair": Grain(["date", "batter", "pitcher"], ["n", "pa", "hr", *moments(launch)]),
        "profile": Grain(["pitcher", "hand"], ["past_n", "past_speed_sum", "past_speed_n"]),
        "starter": Grain(["game_pk", "def_team", "pitcher"], ["n"]),
    }


def day_tables(
    rows: DataFrame, means: list[str], pitch_types: list[str], parts: dict[str, Column], fit_before: str | None = None,
    wanted: tuple[str, ...] | None = None,
) -> dict[str, DataFrame]:
    """The tables ``batter``, ``game``, ``hand``, ``pitcher``, ``pair``, ``profile`` and ``starter`` of prepared event rows.

    ``parts`` are further event-grain columns to be summed by (batter, day). Profiles count rows before ``fit_before``.
    ``wanted`` names the tables to build, all of them by default.
    """
    grains = {name: g for name, g in grains_of(means, pitch_types).items() if wanted is None or name in wanted}
    keys = [k for k in KEYS if any(k in g.keys for g in grains.values())]
    measures = event_measures(means, pitch_types)
    past = F.lit(True) if fit_before is None else F.coalesce(F.col("date") < F.lit(fit_before).cast("date"), F.lit(False))
    for name, m in (("n", "n"), ("speed_sum", "release_speed_sum"), ("speed_n", "release_speed_n")):
        measures[f"past_{name}"] = F.when(past, measures[m])
    wide = {m: e for m, e in {**measures, **parts}.items() if not m.startswith(("n_", "past_", "release_speed"))}

    slots = max((len(g.measures) for g in grains.values()), default=0)
    number = {name: k for k, name in enumerate(grains)}

    def by_grain(values: dict[int, Column]) -> Column:
        return first_matching([(F.col("grain") == k, v) for k, v in values.items()])

    def others() -> DataFrame:
        place = {"place": place_in_game()} if "starter" in grains else {}
        tagged = rows.withColumns({"hand": F.col("p_throws"), "grain": F.explode(F.array(*[F.lit(k) for k in number.values()]))}).select(
            "grain", *[by_grain({number[n]: F.col(k) for n, g in grains.items() if k in g.keys}).alias(k) for k in keys],
            *[by_grain({number[n]: measures[g.measures[j]].cast("double") for n, g in grains.items() if j < len(g.measures)}).alias(f"s{j}") for j in range(slots)],
            *[by_grain({number["starter"]: v}).alias(k) for k, v in place.items()])
        return tagged.groupBy("grain", *keys).agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(slots)], *[F.min(k).alias(k) for k in place])

    plans = {"others": others} if grains else {}
    if wanted is None or "batter" in wanted:
        plans["batter"] = lambda: rows.groupBy("date", "batter").agg(*[F.sum(e).alias(m) for m, e in wide.items()])
    written = written_side_by_side(plans, by={"others": "grain"})
    out = {"batter": written["batter"]} if "batter" in written else {}
    for name, g in grains.items():
        own = written["others"].where(F.col("grain") == number[name])
        counts = [F.col(f"s{j}").cast("double" if m.endswith("_sum") else "bigint").alias(m) for j, m in enumerate(g.measures)]
        out[name] = own.select(*g.keys, *counts, *(["place"] if name == "starter" else []))
    return out


def starters_of(starters: DataFrame) -> DataFrame:
    """The pitcher who stands first in a game for each defending team."""
    return starters.groupBy("game_pk", "def_team").agg(F.min_by("pitcher", F.struct("place", "pitcher")).alias("opp_starter"))
