"""Streak, momentum, velocity, pattern and confidence features.

Input are game rows. They collapse to one state per (entity, day) of fixed size, whatever the number of games: counts,
hits, the first two and the last five outcomes, and what happened after two misses inside the day. States of following
days add up, so one range window over the days before collects a short array (at most ``days`` states) and every feature
is a fold over that array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions import arrays as a
from fairline.functions.columns import day_number
from fairline.functions.windows import days_before


@dataclass(frozen=True)
class StreakParameters:
    """Fixed values of the streak features; every one may be overridden."""

    min_length: int = 3
    lookback: int = 21
    hot: float = 0.15
    cold: float = 0.05
    momentum_days: int = 7
    velocity_days: int = 5
    tau: float = 7.0


DEFAULTS = StreakParameters()


#: Newest outcomes that a day's state keeps.
NEWEST = 5


def day_states(
    games: DataFrame, entity: str, day: str, tie: str, hit: str, leverage: str | None = None, clutch: str | None = None,
) -> DataFrame:
    """One state per (entity, day): ``rate``, ``n``, ``hits``, ``ones``, ``first``, ``last``, ``chances``, ``taken``, leverage sums, ``clutch``.

    ``chances`` are games right after two misses of the same day, ``taken`` those with a hit; ``first`` and ``last``
    carry what chances across days need. One sort by (entity, day, tie) serves all; the rows of a day are streamed, and
    what is collected are ``NEWEST`` outcomes at most.
    """
    none = F.lit(None).cast("int")
    rows = games.select(
        entity, day, F.col(tie).alias("_tie"), F.col(hit).cast("double").alias("_hit"),
        (F.col(leverage).cast("int") if leverage else none).alias("_lev"), (F.col(clutch).cast("int") if clutch else none).alias("_clu"),
    )
    keys = [entity, day]
    order = ["_tie", "_hit", "_lev", "_clu"]
    up = Window.partitionBy(*keys).orderBy(*order)
    down = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    through = down.rowsBetween(Window.unboundedPreceding, 0)
    hit_, lev, clu = F.col("_hit"), F.col("_lev"), F.col("_clu")
    placed = rows.select(
        "*", F.row_number().over(up).alias("_up"), F.row_number().over(down).alias("_down"), F.lag("_hit").over(up).alias("_one"),
        F.lag("_hit", 2).over(up).alias("_two"), F.sum(F.when(clu == 1, 1).otherwise(0)).over(through).alias("_clutch"),
    )

    def newest(rank: str, condition: Column) -> Column:
        kept = F.collect_list(F.when(condition & (F.col(rank) <= NEWEST), F.struct((-F.col(rank)).alias("k"), hit_.alias("hit"))))
        return F.transform(F.sort_array(kept), lambda x: x["hit"])

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0)).cast("int")

    chance = (F.col("_one") == 0) & (F.col("_two") == 0)
    return placed.groupBy(*keys).agg(
        F.avg("_hit").alias("rate"), F.count(F.lit(1)).alias("n"), F.sum("_hit").alias("hits"), F.count("_hit").alias("known"),
        F.sum(F.when(hit_ == 1, 1).otherwise(0)).alias("ones"),
        F.struct(*[F.max(F.when(F.col("_up") == k, hit_)).alias(f"h{k}") for k in (1, 2)]).alias("first"),
        newest("_down", F.lit(True)).alias("last"), F.max(F.when(F.col("_down") == 1, hit_)).alias("h_1"), F.max(F.when(F.col("_down") == 2, hit_)).alias("h_2"),
        count(chance).alias("chances"), count(chance & (hit_ == 1)).alias("taken"),
        *[e.alias(f"{n}_{k}") for k in (0, 1) for n, e in (("lev_n", F.count(F.when(lev == k, hit_))), ("lev_hits", F.sum(F.when(lev == k, hit_).otherwise(0.0))))],
        newest("_clutch", clu == 1).alias("clutch"),
    ).withColumn("dn", day_number(day))


_STATE = ["dn", "rate", "n", "hits", "known", "ones", "first", "last", "h_1", "h_2", "chances", "taken", "lev_n_0", "lev_hits_0", "lev_n_1", "lev_hits_1", "clutch"]


def recent_days(
    games: DataFrame, entity: str, day: str, tie: str, hit: str, leverage: str | None = None, clutch: str | None = None,
    params: StreakParameters = DEFAULTS,
) -> DataFrame:
    """Per (entity, day): ``history`` = states of the earlier days within the look-back, oldest first."""
    daily = day_states(games, entity, day, tie, hit, leverage, clutch)
    frame = days_before([entity], "dn", params.lookback)
    return daily.select(entity, day, "dn", F.collect_list(F.struct(*_STATE)).over(frame).alias("history"))


def rates(history: Column) -> Column:
    return F.transform(history, lambda x: x["rate"])


def game_count(history: Column) -> Column:
    return F.aggregate(history, F.lit(0).cast("bigint"), lambda s, x: s + x["n"])


def _total(history: Column, field: str) -> Column:
    return a.total(F.transform(history, lambda x: x[field].cast("double")))


def newest_hits(history: Column) -> Column:
    """The last five outcomes of the look-back."""
    return a.last_n(F.flatten(F.transform(history, lambda x: x["last"])), NEWEST)


def within(history: Column, dn: Column, days: int) -> Column:
    return F.filter(history, lambda x: x["dn"] >= dn - days)


def is_hot(x: Column, p: StreakParameters = DEFAULTS) -> Column:
    return x["rate"] >= p.hot


def is_cold(x: Column, p: StreakParameters = DEFAULTS) -> Column:
    return x["rate"] <= p.cold


def runs(history: Column, condition, min_length: int) -> Column:
    """One pass over the days: current run, longest run, qualifying runs, last day inside one."""
    def step(s, x):
        run = F.when(condition(x), s["run"] + 1).otherwise(0)
        return F.struct(
            run.alias("run"), F.greatest(s["best"], run).alias("best"),
            (s["count"] + F.when(run == min_length, 1).otherwise(0)).alias("count"),
            F.when(run >= min_length, x["dn"]).otherwise(s["last"]).alias("last"),
        )

    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("count"),
                     F.lit(None).cast("int").alias("last"))
    return F.aggregate(history, start, step)


def current_streak(state: Column) -> Column:
    """Length of the run that ends on the newest day."""
    return state["run"]


def max_streak(state: Column) -> Column:
    """Longest run."""
    return state["best"]


def _recency(history: Column, value, tau: float) -> Column:
    newest = a.last(history)["dn"]

    def weight(x):
        return F.exp((x["dn"] - newest) / F.lit(tau))

    top = a.total(F.transform(history, lambda x: weight(x) * value(x["rate"])))
    return F.coalesce(top / F.nullif(a.total(F.transform(history, weight)), F.lit(0.0)), F.lit(0.0))


@a.bound
def streak_intensity(history: Column, p: StreakParameters = DEFAULTS) -> Column:
    """Recency-weighted excess over the hot threshold."""
    return _recency(history, lambda r: F.greatest(F.lit(0.0), r - p.hot), p.tau)


@a.bound
def streak_depth(history: Column, p: StreakParameters = DEFAULTS) -> Column:
    """Recency-weighted shortfall below the cold threshold."""
    return _recency(history, lambda r: F.greatest(F.lit(0.0), p.cold - r), p.tau)


def days_since_streak(state: Column, dn: Column) -> Column:
    """Days since the last day inside a qualifying run, null without one."""
    return (dn - state["last"]).cast("double")


def streak_frequency(state: Column, history: Column) -> Column:
    """Qualifying runs per week of the observed span."""
    span = a.last(history)["dn"] - F.get(history, F.lit(0))["dn"] + 1
    return state["count"] / F.greatest(span / 7.0, F.lit(1.0))


@a.bound
def recovery_momentum(rate: Column, p: StreakParameters = DEFAULTS) -> Column:
    """Slope of the last five rates, scaled by how low the first three of them were."""
    def score(recent: Column) -> Column:
        hole = F.greatest(F.lit(0.0), p.hot - F.array_min(F.slice(recent, 1, 3)))
        return F.when(F.size(recent) >= 3, a.slope(recent) * (1 + 2 * hole)).otherwise(0.0)

    return a.let(a.last_n(rate, 5), score)


@a.bound
def slump_risk(rate: Column, p: StreakParameters = DEFAULTS) -> Column:
    """Falling slope, low last rate and share of low rates among the last five, at most 1."""
    def score(recent: Column) -> Column:
        fall = a.let(a.slope(recent), lambda m: F.when(m < 0, 2 * F.abs(m)).otherwise(0.0))
        low = a.let(a.last(recent), lambda r: F.when(r < p.cold, 3 * (p.cold - r)).otherwise(0.0))
        share = F.size(F.filter(recent, lambda r: r < p.cold)) / F.size(recent) * 0.5
        return F.when(F.size(recent) >= 3, F.least(fall + low + share, F.lit(1.0))).otherwise(0.0)

    return a.let(a.last_n(rate, 5), score)


@a.bound
def power_momentum(values: Column, tau: float = 3.0) -> Column:
    """Weighted mean, weight exp(-k/3) with k counted from the end."""
    n = F.size(values)

    def w(i):
        return F.exp((i - n + 1) / F.lit(tau))

    return a.total(F.transform(values, lambda y, i: y * w(i))) / a.total(F.transform(values, lambda y, i: w(i)))


def launch_power(speed: Column, angle: Column) -> Column:
    """W24 input where launch data exist: speed along the best launch angle."""
    return speed * F.cos(F.radians(angle - 25))


def consistency_momentum(rate: Column) -> Column:
    """Inverse variance."""
    return 1 / (1 + 10 * a.variance(rate))


@a.bound
def momentum_sustainability(rate: Column) -> Column:
    """Consistency times sample size times level of the last three rates, at most 1."""
    level = F.least(a.mean(a.last_n(rate, 3)) / F.greatest(a.mean(rate), F.lit(0.01)), F.lit(2.0)) / 2
    return F.least(1 / (1 + 5 * a.variance(rate)) * F.least(F.size(rate) / 10.0, F.lit(1.0)) * level, F.lit(1.0))


@a.bound
def trend_acceleration(rate: Column) -> Column:
    """Twice the quadratic coefficient, 0 below four days."""
    return F.when(F.size(rate) >= 4, 2 * a.curvature(rate)).otherwise(0.0)


@a.bound
def momentum_direction(rate: Column) -> Column:
    """Sign of the slope with a flat band of 0.001."""
    return a.let(a.slope(rate), lambda m: F.when(m.isNull() | (F.abs(m) < 0.001), 0).when(m > 0, 1).otherwise(-1))


def momentum_strength(rate: Column) -> Column:
    """Magnitude of the slope."""
    return F.coalesce(F.abs(a.slope(rate)), F.lit(0.0))


@a.bound
def rate_velocity(rate: Column) -> Column:
    """Mean of the last three differences."""
    return F.when(F.size(rate) >= 2, a.mean(a.last_n(a.differences(rate), 3))).otherwise(0.0)


@a.bound
def rate_acceleration(rate: Column) -> Column:
    """Mean of the last two second differences."""
    return F.when(F.size(rate) >= 3, a.mean(a.last_n(a.differences(a.differences(rate)), 2))).otherwise(0.0)


@a.bound
def velocity_consistency(rate: Column) -> Column:
    """Inverse variance of the differences."""
    return F.when(F.size(rate) >= 3, 1 / (1 + 20 * a.variance(a.differences(rate)))).otherwise(0.0)


@a.bound
def breakout_velocity(rate: Column, p: StreakParameters = DEFAULTS) -> Column:
    """Improvement over the last three rates, larger from a low start."""
    def score(recent: Column) -> Column:
        start = F.get(recent, F.lit(0))
        gain = (a.last(recent) - start) * (1 + F.greatest(F.lit(0.0), p.hot - start))
        return F.when(F.size(rate) >= 3, F.greatest(F.lit(0.0), gain)).otherwise(0.0)

    return a.let(a.last_n(rate, 3), score)


@a.bound
def cycle_position(rate: Column) -> Column:
    """Three-day mean against seven-day mean with a band of 0.05."""
    band = a.let(a.mean(a.last_n(rate, 3)) - a.mean(a.last_n(rate, 7)), lambda g: F.when(g > 0.05, 1.0).when(g < -0.05, -1.0).otherwise(0.0))
    return F.when(F.size(rate) < 7, 0.0).otherwise(band)


@a.bound
def cycle_prediction(rate: Column) -> Column:
    """Last rate plus slope of the last five."""
    return a.let(a.last_n(rate, 5), lambda recent: F.when(F.size(recent) >= 3, a.last(rate) + a.slope(recent)).otherwise(0.0))


@a.bound
def pattern_stability(rate: Column) -> Column:
    """Inverse relative deviation, 0 below five days or with mean 0."""
    return a.let(a.mean(rate), lambda mu: F.when(
        (F.size(rate) >= 5) & (mu != 0), 1 / (1 + F.sqrt(a.variance(rate)) / mu)).otherwise(0.0))


@a.bound
def rhythm_indicator(history: Column) -> Column:
    """Inverse variance of the gaps between games with a hit, at least three of them.

    Hits of one day are no days apart, so their number and the days of hits say it all.
    """
    def step(s, x):
        gap = F.when(s["day"].isNotNull(), (x["dn"] - s["day"]).cast("double")).otherwise(0.0)
        some = x["ones"] > 0
        return F.struct(
            F.when(some, x["dn"]).otherwise(s["day"]).alias("day"), (s["n"] + x["ones"]).alias("n"),
            F.when(some, s["sum"] + gap).otherwise(s["sum"]).alias("sum"), F.when(some, s["squares"] + gap * gap).otherwise(s["squares"]).alias("squares"),
        )

    start = F.struct(F.lit(None).cast("int").alias("day"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("squares"))

    def score(s: Column) -> Column:
        gaps = s["n"] - 1
        variance = F.greatest((s["squares"] - s["sum"] * s["sum"] / gaps) / (gaps - 1), F.lit(0.0))
        return F.when(s["n"] >= 3, 1 / (1 + variance / 5)).otherwise(0.0)

    return a.let(F.aggregate(history, start, step), score)


@a.bound
def confidence_indicator(history: Column) -> Column:
    """Last five games against all, damped by their variance, at most 2."""
    mean = _total(history, "hits") / F.nullif(_total(history, "known"), F.lit(0.0))
    level = F.greatest(mean, F.lit(0.01))
    return a.let(newest_hits(history), lambda recent: F.least(a.mean(recent) / level / (1 + 5 * a.variance(recent)), F.lit(2.0)))


@a.bound
def mental_toughness(history: Column) -> Column:
    """Share of games with a hit right after two without; a day's first two games look back to the days before."""
    def after(two, one, now):
        chance = (two == 0) & (one == 0)
        return F.when(chance, 1).otherwise(0), F.when(chance & (now == 1), 1).otherwise(0)

    def step(s, x):
        n1, k1 = after(s["b"], s["a"], x["first"]["h1"])
        n2, k2 = after(s["a"], x["first"]["h1"], x["first"]["h2"])
        more = x["n"] > 1
        return F.struct(
            F.when(more, x["h_2"]).otherwise(s["a"]).alias("b"), x["h_1"].alias("a"),
            (s["n"] + n1 + F.when(more, n2).otherwise(0) + x["chances"]).alias("n"), (s["k"] + k1 + F.when(more, k2).otherwise(0) + x["taken"]).alias("k"),
        )

    start = F.struct(F.lit(-1.0).alias("b"), F.lit(-1.0).alias("a"), F.lit(0).alias("n"), F.lit(0).alias("k"))
    return a.let(F.aggregate(history, start, step), lambda s: F.when(
        (game_count(history) >= 5) & (s["n"] > 0), s["k"] / s["n"]).otherwise(0.0))


@a.bound
def pressure_response(history: Column) -> Column:
    """Rate in high-leverage games over the rate in the others."""
    def rate(flag: int) -> Column:
        return _total(history, f"lev_hits_{flag}") / F.nullif(_total(history, f"lev_n_{flag}"), F.lit(0.0))

    return F.coalesce(a.let(rate(0), lambda regular: F.when(regular.isNotNull(), rate(1) / F.greatest(regular, F.lit(0.01)))), F.lit(0.0))


def clutch_momentum(history: Column) -> Column:
    """Slope of the daily rates of the last five clutch games."""
    def score(last5: Column) -> Column:
        days = F.array_distinct(F.transform(last5, lambda g: g["dn"]))
        return a.slope(F.transform(days, lambda d: a.mean(
            F.transform(F.filter(last5, lambda g: g["dn"] == d), lambda g: g["hit"]))))

    games = F.flatten(F.transform(history, lambda x: F.transform(x["clutch"], lambda h: F.struct(x["dn"].alias("dn"), h.alias("hit")))))
    return F.coalesce(a.let(a.last_n(games, NEWEST), score), F.lit(0.0))


def streak_feature_set(
    games: DataFrame, entity: str, day: str, tie: str, hit: str, leverage: str | None = None, clutch: str | None = None,
    params: StreakParameters = DEFAULTS,
) -> DataFrame:
    """All features from one window; short histories give 0, missing streaks null."""
    base = recent_days(games, entity, day, tie, hit, leverage, clutch, params)
    h, dn = F.col("history"), F.col("dn")
    staged = base.select(
        entity, day, "dn", "history", within(h, dn, params.momentum_days).alias("h7"),
        within(h, dn, params.velocity_days).alias("h5"),
    ).select(
        "*", game_count(h).alias("g21"), game_count(F.col("h7")).alias("g7"), game_count(F.col("h5")).alias("g5"),
        rates(h).alias("r21"), rates(F.col("h7")).alias("r7"), rates(F.col("h5")).alias("r5"),
        runs(h, lambda x: is_hot(x, params), params.min_length).alias("hot"),
        runs(h, lambda x: is_cold(x, params), params.min_length).alias("cold"),
    )
    hot, cold, r21, r7, r5 = (F.col(c) for c in ("hot", "cold", "r21", "r7", "r5"))

    def enough(count: str, minimum: int, value: Column, default=0.0) -> Column:
        return F.when(F.col(count) >= minimum, value).otherwise(default)

    features = {
        "current_hot_streak": enough("g21", 3, current_streak(hot), 0),
        "max_hot_streak_21d": enough("g21", 3, max_streak(hot), 0),
        "hot_streak_intensity": enough("g21", 3, streak_intensity(h, params)),
        "days_since_hot_streak": F.when(F.col("g21") >= 3, days_since_streak(hot, dn)),
        "hot_streak_frequency": enough("g21", 3, streak_frequency(hot, h)),
        "current_cold_streak": enough("g21", 3, current_streak(cold), 0),
        "max_cold_streak_21d": enough("g21", 3, max_streak(cold), 0),
        "cold_streak_depth": enough("g21", 3, streak_depth(h, params)),
        "days_since_cold_streak": F.when(F.col("g21") >= 3, days_since_streak(cold, dn)),
        "cold_streak_frequency": enough("g21", 3, streak_frequency(cold, h)),
        "recovery_momentum": enough("g21", 3, recovery_momentum(r21, params)),
        "slump_risk_indicator": enough("g21", 3, slump_risk(r21, params)),
        "power_momentum_7d": enough("g7", 3, power_momentum(r7)),
        "consistency_momentum": enough("g7", 3, consistency_momentum(r7)),
        "momentum_sustainability": enough("g7", 3, momentum_sustainability(r7)),
        "trend_acceleration": enough("g7", 4, trend_acceleration(r7)),
        "momentum_direction": enough("g7", 3, momentum_direction(r7), 0),
        "momentum_strength": enough("g7", 3, momentum_strength(r7)),
        "hr_rate_velocity": enough("g5", 2, rate_velocity(r5)),
        "performance_acceleration": enough("g5", 3, rate_acceleration(r5)),
        "velocity_consistency": enough("g5", 3, velocity_consistency(r5)),
        "breakout_velocity": enough("g5", 3, breakout_velocity(r5, params)),
        "hot_cold_cycle_position": enough("g21", 5, cycle_position(r21)),
        "pattern_stability": enough("g21", 5, pattern_stability(r21)),
        "rhythm_indicator": enough("g21", 5, rhythm_indicator(h)),
        "cycle_prediction": enough("g21", 7, cycle_prediction(r21)),
        "confidence_indicator": enough("g21", 3, confidence_indicator(h)),
        "mental_toughness": enough("g21", 5, mental_toughness(h)),
    }
    if leverage:
        features["pressure_response"] = enough("g21", 3, pressure_response(h))
    if clutch:
        features["clutch_momentum"] = enough("g21", 3, clutch_momentum(h))
    return staged.select(entity, day, *[c.alias(n) for n, c in features.items()])
