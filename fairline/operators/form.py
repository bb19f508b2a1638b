"""Exponentially decayed form and trend features.

Events collapse to (entity, day) sums first. A decayed window sum
``sum(v_s * exp(-(t - s) / tau))`` then separates into a plain range-frame sum
of ``v_s * exp(s / tau)`` scaled by ``exp(-t / tau)``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions import arrays
from fairline.functions.columns import day_number
from fairline.functions.windows import days_before

_BLOCK = 1024


@dataclass(frozen=True)
class Decay:
    """Decay of daily weights: ``max(exp(-d / tau), floor)`` over ``days`` days."""

    tau: float
    floor: float
    days: int

    @staticmethod
    def half_life(half: float, floor: float, days: int) -> "Decay":
        return Decay(half / math.log(2), floor, days)


# The decay settings of each feature family.
RECENT = Decay(14.0, 0.01, 60)
POWER = Decay.half_life(14, 0.05, 60)
CONTACT = Decay.half_life(21, 0.03, 75)
DISCIPLINE = Decay.half_life(28, 0.02, 90)
HOT_COLD = Decay.half_life(7, 0.1, 30)


def decay_weight(days_ago: Column, decay: Decay) -> Column:
    """The weight itself."""
    return F.greatest(F.exp(-days_ago / F.lit(decay.tau)), F.lit(decay.floor))


def decayed_sums(df: DataFrame, keys: list[str], dn: str, measures: dict[str, Column], decay: Decay) -> DataFrame:
    """Add a decayed sum over ``[d - days, d - 1]`` per measure.

    Day numbers are rebased per block of 1024 days so the scale factor cannot
    overflow; a frame meets at most two blocks, told apart by their parity.
    Days on which the floor binds get their own flat frame.
    """
    tau, day = decay.tau, F.col(dn)
    bound = math.ceil(tau * math.log(1 / decay.floor)) if decay.floor > 0 else decay.days + 1
    far = min(decay.days, bound - 1)
    position, parity = F.pmod(day, F.lit(_BLOCK)), F.pmod(F.floor(day / _BLOCK), F.lit(2))
    grown = F.exp(position / F.lit(tau))
    staged = df.select(
        "*", *[c.cast("double").alias(f"_v_{n}") for n, c in measures.items()], position.alias("_pos"), parity.alias("_par"),
    ).withColumns({
        f"_{side}_{n}": F.when(F.col("_par") == side, F.col(f"_v_{n}") * grown) for n in measures for side in (0, 1)
    })
    frame = days_before(keys, dn, far)
    same, other = F.exp(-F.col("_pos") / F.lit(tau)), F.exp(-(F.col("_pos") + _BLOCK) / F.lit(tau))

    def part(n: str) -> Column:
        zero = F.lit(0.0)
        s0 = F.coalesce(F.sum(f"_0_{n}").over(frame), zero)
        s1 = F.coalesce(F.sum(f"_1_{n}").over(frame), zero)
        near = F.when(F.col("_par") == 0, s0 * same + s1 * other).otherwise(s1 * same + s0 * other)
        if bound <= decay.days:
            flat = F.sum(f"_v_{n}").over(days_before(keys, dn, decay.days, until=bound))
            near = near + F.lit(decay.floor) * F.coalesce(flat, zero)
        return near

    return staged.select(*df.columns, *[part(n).alias(n) for n in measures])


def form_days(
    events: DataFrame, entity: str, day: str, attempt: str, hit: str, speed: str, angle: str,
    zone: str | None = None, swing: str | None = None, whiff: str | None = None, barrel: tuple[float, float] = (25, 35),
) -> DataFrame:
    """(entity, day) sums every form feature is built from."""
    v, g = F.col(speed), F.col(angle)

    def n(condition: Column) -> Column:
        return F.sum(F.coalesce(condition, F.lit(False)).cast("bigint"))

    extra = []
    if zone and swing and whiff:
        inside, swung, missed = F.col(zone) == 1, F.col(swing) == 1, F.col(whiff) == 1
        extra = [n(swung).alias("swings"), n(swung & ~missed).alias("contacts"), n(inside & swung).alias("z_swings"),
                 n(inside & swung & ~missed).alias("z_contacts"), n(~inside).alias("outside"),
                 n(~inside & swung).alias("chases"), n(swung & missed).alias("whiffs")]
    return events.groupBy(entity, day).agg(
        F.count(F.lit(1)).alias("n"), F.sum(attempt).alias("pa"), F.sum(hit).alias("hr"),
        F.sum(v).alias("ev"), F.count(v).alias("ev_n"), n(v >= 95).alias("hard"),
        n((v >= 98) & g.between(*barrel)).alias("barrel"), F.sum(g).alias("la"), F.sum(g * g).alias("la2"),
        F.count(g).alias("la_n"), n(g.between(8, 32)).alias("sweet"), n(g.between(10, 25)).alias("line"), *extra,
    ).withColumn("dn", day_number(day))


def _share(top: str, bottom: str, floor: float | None = None) -> Column:
    b = F.col(bottom)
    if floor is not None:
        return F.col(top) / F.greatest(b, F.lit(floor))
    return F.coalesce(F.when(b > 0, F.col(top) / b), F.lit(0.0))


def decayed_power_form(days: DataFrame, entity: str, decay: Decay = RECENT, floored: bool = False) -> DataFrame:
    """Decayed hit rate, mean speed, hard-hit, barrel and isolated power.

    ``floored`` is the base variant: contact denominators of at least 1.
    """
    names = ["n", "pa", "hr", "ev", "ev_n", "hard", "barrel"]
    sums = decayed_sums(days, [entity], "dn", {f"w_{c}": F.col(c) for c in names}, decay)
    floor = 1.0 if floored else None
    return sums.select(
        *days.columns,
        _share("w_hr", "w_pa", floor).alias("power_form_hr_rate"), _share("w_ev", "w_ev_n", floor).alias("power_form_avg_ev"),
        _share("w_hard", "w_ev_n", floor).alias("power_form_hard_hit_rate"),
        _share("w_barrel", "w_ev_n" if floored else "w_n", floor).alias("power_form_barrel_rate"),
        (3 * _share("w_hr", "w_n")).alias("power_form_iso_power"),
    )


def decayed_contact_form(days: DataFrame, entity: str, decay: Decay = RECENT, floored: bool = False) -> DataFrame:
    """Decayed mean angle, sweet-spot and line-drive shares, consistency from weighted moments."""
    sums = decayed_sums(days, [entity], "dn", {f"w_{c}": F.col(c) for c in ("la", "la2", "la_n", "sweet", "line")}, decay)
    count = F.coalesce(F.sum("la_n").over(days_before([entity], "dn", decay.days)), F.lit(0))
    sums = sums.withColumn("_count", count)
    floor = 1.0 if floored else None
    weight = F.greatest(F.col("w_la_n"), F.lit(1.0)) if floored else F.col("w_la_n")
    mean = F.col("w_la") / weight
    spread = F.sqrt(F.greatest(
        (F.col("w_la2") - 2 * mean * F.col("w_la") + mean * mean * F.col("w_la_n")) / weight, F.lit(0.0)))
    scale, enough = (10.0, F.col("_count") > 3) if floored else (1.0, F.col("_count") >= 5)
    return sums.select(
        *days.columns,
        _share("w_la", "w_la_n", floor).alias("contact_form_avg_la"), _share("w_sweet", "w_la_n", floor).alias("contact_form_sweet_spot_rate"),
        _share("w_line", "w_la_n", floor).alias("contact_form_line_drive_rate"),
        F.when(enough, 1 / (1 + spread / scale)).otherwise(0.0).alias("contact_form_consistency"),
    )


def discipline_form(days: DataFrame, entity: str, decay: Decay = RECENT) -> DataFrame:
    """Decayed swing decisions, or a proxy from the spread of angles where swings are unknown."""
    if "swings" in days.columns:
        names = ["swings", "contacts", "z_swings", "z_contacts", "outside", "chases", "whiffs"]
        sums = decayed_sums(days, [entity], "dn", {f"w_{c}": F.col(c) for c in names}, decay)
        return sums.select(
            *days.columns, _share("w_contacts", "w_swings").alias("discipline_form_contact_rate"),
            _share("w_z_contacts", "w_z_swings").alias("discipline_form_z_contact_rate"),
            _share("w_chases", "w_outside").alias("discipline_form_chase_rate"),
            _share("w_whiffs", "w_swings").alias("discipline_form_whiff_rate"),
        )
    frame = days_before([entity], "dn", decay.days)
    n, s, s2 = (F.sum(c).over(frame) for c in ("la_n", "la", "la2"))
    sd = F.when(n > 1, F.sqrt(F.greatest((s2 - s * s / n) / (n - 1), F.lit(0.0))))
    staged = days.select("*", F.when(F.sum("n").over(frame) >= 10, sd).alias("_sd"))

    def value(column: Column) -> Column:
        return F.coalesce(column, F.lit(0.0))

    return staged.select(
        *days.columns, value(1 / (1 + F.col("_sd") / 30)).alias("discipline_form_contact_rate"),
        value(1 / (1 + F.col("_sd") / 25)).alias("discipline_form_z_contact_rate"),
        value(F.col("_sd") / 50).alias("discipline_form_chase_rate"), value(F.col("_sd") / 45).alias("discipline_form_whiff_rate"),
    )


def recent_n_indicators(
    events: DataFrame, entity: str, day: str, order: list[str], hit: str, speed: str, days: int = 60,
) -> DataFrame:
    """Hot, cold, slump, surge and momentum from the last 10 or 20 events before each day.

    One sort ranks a day's events from its end; each day keeps its newest 20 outcomes and 10 speeds, and counts no more
    than 20 events, which is all that the thresholds ask. A game needs no more than the days of its look-back, so arrays
    stay short however many events a day has.
    """
    keep = {"hits": 20, "speeds": 10}
    back = Window.partitionBy(entity, day).orderBy(*[F.desc(c) for c in order])
    through = back.rowsBetween(Window.unboundedPreceding, 0)
    ranked = events.select(
        entity, day, F.col(hit).cast("double").alias("_hits"), F.col(speed).cast("double").alias("_speeds"), F.row_number().over(back).alias("_k"),
        F.count(hit).over(through).alias("_k_hits"), F.count(speed).over(through).alias("_k_speeds"),
    ).where((F.col("_k_hits") <= keep["hits"]) | (F.col("_k_speeds") <= keep["speeds"]) | (F.col("_k") <= 20))

    def newest(name: str) -> Column:
        inside = F.col(f"_{name}").isNotNull() & (F.col(f"_k_{name}") <= keep[name])
        pairs = F.sort_array(F.collect_list(F.when(inside, F.struct((-F.col("_k")).alias("k"), F.col(f"_{name}").alias("x")))))
        return F.transform(pairs, lambda p: p["x"]).alias(f"_{name}")

    daily = ranked.groupBy(entity, day).agg(F.count(F.when(F.col("_k") <= 20, 1)).alias("n"), newest("hits"), newest("speeds")).withColumn("dn", day_number(day))
    frame = days_before([entity], "dn", days)
    staged = daily.select(
        entity, day, F.coalesce(F.sum("n").over(frame), F.lit(0)).alias("seen"),
        arrays.last_n(F.flatten(F.collect_list("_hits").over(frame)), 20).alias("h"),
        arrays.last_n(F.flatten(F.collect_list("_speeds").over(frame)), 10).alias("v"),
    )
    h, v, seen = F.col("h"), F.col("v"), F.col("seen")
    rate = arrays.mean(arrays.last_n(h, 10))
    change = arrays.mean(arrays.last_n(h, 5)) - arrays.mean(F.slice(h, 1, 5))

    def above(value: Column, guard: Column) -> Column:
        return F.when(guard, F.greatest(F.lit(0.0), value)).otherwise(0.0)

    return staged.select(
        entity, day, above((rate - 0.12) * 10, seen >= 10).alias("hot_streak_indicator"),
        above((0.08 - rate) * 10, seen >= 10).alias("cold_streak_indicator"),
        above((0.05 - rate) * 10, seen >= 10).alias("recent_slump_indicator"),
        above((arrays.mean(v) - 88) / 10, (seen >= 10) & (F.size(v) >= 5)).alias("recent_power_surge"),
        F.when(seen >= 20, F.tanh(change * 10)).otherwise(0.0).alias("momentum_score"),
    )


def decayed_indicators(days: DataFrame, entity: str, decay: Decay = HOT_COLD) -> DataFrame:
    """W15, base variant: hot, cold and surge from decayed sums, momentum as tanh of their balance."""
    sums = decayed_sums(days, [entity], "dn", {f"w_{c}": F.col(c) for c in ("n", "pa", "hr", "ev", "ev_n")}, decay)
    seen = F.col("w_n") > 0
    rate = _share("w_hr", "w_pa", 1.0)
    zero = F.lit(0.0)
    rated = sums.select(
        *days.columns, F.when(seen, F.greatest(zero, (rate - 0.12) * 10)).otherwise(0.0).alias("hot_streak_indicator"),
        F.when(seen, F.greatest(zero, (0.08 - rate) * 10)).otherwise(0.0).alias("cold_streak_indicator"),
        F.when(F.col("w_ev_n") > 0, F.greatest(zero, (_share("w_ev", "w_ev_n", 1.0) - 88) / 10)).otherwise(0.0).alias("recent_power_surge"),
    )
    balance = F.col("hot_streak_indicator") - F.col("cold_streak_indicator") + F.col("recent_power_surge")
    return rated.withColumn("momentum_score", F.tanh(balance))


def trend_slopes(days: DataFrame, entity: str, scale: float = 100.0) -> DataFrame:
    """Least-squares slopes of the daily hit rate (scaled) and mean speed over 7, 14 and 30 days."""
    rated = days.select(
        "*", (F.col("hr") / F.greatest(F.col("pa"), F.lit(1))).alias("_rate"),
        (F.col("ev") / F.nullif(F.col("ev_n"), F.lit(0))).alias("_ev"), F.col("dn").cast("double").alias("_x"),
    )

    def slope(y: str, n: int, minimum_values: bool, factor: float) -> Column:
        frame = days_before([entity], "dn", n)
        guard = (F.sum("n").over(frame) >= 5) & (F.count(F.lit(1)).over(frame) >= 3)
        if minimum_values:
            guard = guard & (F.count(y).over(frame) >= 3)
        return F.coalesce(F.when(guard, F.regr_slope(F.col(y), F.col("_x")).over(frame) * factor), F.lit(0.0))

    out = rated.select(
        *days.columns, *[slope("_rate", n, False, scale).alias(f"hr_rate_trend_{n}d") for n in (7, 14, 30)],
        *[slope("_ev", n, True, 1.0).alias(f"ev_trend_{n}d") for n in (7, 14, 30)],
    )
    return out.withColumn("form_acceleration", F.col("hr_rate_trend_7d") - F.col("hr_rate_trend_14d"))
