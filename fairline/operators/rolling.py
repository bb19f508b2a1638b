"""Lagged rolling and expanding features over entity-day rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairline.functions.columns import clip, day_number, flag
from fairline.functions.windows import START, all_before, days_through, ordered, rows_before
from fairline.operators.join import asof_join

EPS = 1e-6


def rolling_rows_lagged(
    df: DataFrame, keys: list[str], order: list[str], sums: list[str], means: list[str], n: int = 10, lag: int = 1,
    prefix: str = "roll{n}_",
) -> DataFrame:
    """Sum or mean of the ``n`` rows that end ``lag`` rows back."""
    frame, p = rows_before(keys, order, n, lag), prefix.format(n=n)
    return df.select(
        "*", *[F.sum(c).over(frame).alias(f"{p}{c}") for c in sums], *[F.avg(c).over(frame).alias(f"{p}{c}") for c in means]
    )


def rolling_days_lagged(
    df: DataFrame, keys: list[str], day_no: str, sums: list[str], means: list[str], n: int = 30, prefix: str = "roll{n}d_",
) -> DataFrame:
    """The ``n``-day window that ends at the previous row (not at the previous day).

    Both steps use one partitioning and one sort.
    """
    p, frame, step = prefix.format(n=n), days_through(keys, day_no, n), ordered(keys, [day_no])
    inner = df.select(
        "*", *[F.sum(c).over(frame).alias(f"{p}{c}") for c in sums], *[F.avg(c).over(frame).alias(f"{p}{c}") for c in means]
    )
    names = [f"{p}{c}" for c in [*sums, *means]]
    return inner.select(*df.columns, *[F.lag(c).over(step).alias(c) for c in names])


def rate_and_flags(df: DataFrame, rates: dict[str, tuple[str, str]], impact: str, angle: str) -> DataFrame:
    """Hit rates with a small constant below, high-impact and good-angle flags."""
    return df.withColumns({
        **{name: F.col(top) / (F.col(bottom) + EPS) for name, (top, bottom) in rates.items()},
        "prior_high_ev": flag(F.col(impact) > 90),
        "prior_opt_la": flag((F.col(angle) > 15) & (F.col(angle) < 30)),
    })


def split_rolling_pivot(
    daily: DataFrame, entity: str, split: str, values: list[str], day: str, sums: list[str], means: list[str],
    hit: str = "hr", attempt: str = "pa", rows: int = 10, days: int = 30,
) -> DataFrame:
    """W1 and W2 per (entity, split), rates, then one column set per split value.

    The split values are given, so the pivot is one conditional aggregation.
    """
    keys = [entity, split]
    numbered = daily.withColumn("_dn", day_number(day))
    a = rolling_rows_lagged(numbered, keys, ["_dn"], sums, means, rows, prefix="a_")
    b = rolling_days_lagged(a, keys, "_dn", sums, means, days, prefix="b_")
    rated = b.withColumns({
        "a_hr_rate": F.col(f"a_{hit}") / (F.col(f"a_{attempt}") + EPS),
        "b_hr_rate": F.col(f"b_{hit}") / (F.col(f"b_{attempt}") + EPS),
    })
    measures = [*sums, *means, "hr_rate"]
    return rated.groupBy(entity, day).agg(*[
        F.max(F.when(F.col(split) == v, F.col(f"{side}_{m}"))).alias(f"{v}_{m}{tail}")
        for v in values for m in measures for side, tail in (("a", str(rows)), ("b", f"{days}d"))
    ])


def opponent_rolling(
    daily: DataFrame, opponent: str, day: str, rows: int = 10, days: int = 30, cap: float = 0.15,
) -> DataFrame:
    """Opponent form: hits and attempts allowed, impact and speed, attempt-based rates clipped to ``cap``."""
    sums, means = ["hr_allowed", "pa_faced"], ["ev_allowed", "vel"]
    numbered = daily.withColumn("_dn", day_number(day))
    a = rolling_rows_lagged(numbered, [opponent], ["_dn"], sums, means, rows, prefix=f"p_roll{rows}_")
    b = rolling_days_lagged(a, [opponent], "_dn", sums, means, days, prefix=f"p_roll{days}d_")
    return b.withColumns({
        f"p_roll{w}_hr_rate": clip(F.col(f"p_roll{w}_hr_allowed") / (F.col(f"p_roll{w}_pa_faced") + EPS), 0.0, cap)
        for w in (str(rows), f"{days}d")
    }).drop("_dn")


def rolling_mix_fractions(mix: DataFrame, opponent: str, day: str, counts: dict[str, str], days: int = 30) -> DataFrame:
    """Share of each category over the lagged day window; ``counts`` maps category to its zero-filled column."""
    numbered = mix.withColumn("_dn", day_number(day))
    rolled = rolling_days_lagged(numbered, [opponent], "_dn", list(counts.values()), [], days, prefix="r_")
    total = sum((F.coalesce(F.col(f"r_{c}"), F.lit(0)) for c in counts.values()), F.lit(0))
    return rolled.select(
        opponent, day,
        *[F.when(total > 0, F.coalesce(F.col(f"r_{c}"), F.lit(0)) / total).otherwise(0.0).alias(f"mix_{k}") for k, c in counts.items()],
    )


def bases_wide(long: DataFrame, entity: str, day: str, kind: str, kinds: list[str]) -> DataFrame:
    """A5 rows pivoted to zero-filled ``tb_<kind>`` and ``ab_<kind>`` columns."""
    return long.groupBy(entity, day).agg(*[
        F.sum(F.when(F.col(kind) == k, F.col(m)).otherwise(0)).alias(f"{m}_{k}") for k in kinds for m in ("tb", "ab")
    ])


def rolling_slg_wide(wide: DataFrame, entity: str, day: str, kinds: list[str], n: int = 200) -> DataFrame:
    """W7, wide: per category bases over at-bats of the last ``n`` entity rows, null without at-bats.

    Whole numbers are summed up once per entity, and the sum of ``n`` rows is a difference of two running sums, so a row
    costs the same for any ``n``. Other types are summed row by row, as differences would round.
    """
    columns = [f"{m}_{k}" for k in kinds for m in ("ab", "tb")]
    if not all(isinstance(wide.schema[c].dataType, T.IntegralType) for c in columns):
        frame = rows_before([entity], [day], n)
        sums = wide.select(entity, day, *[F.sum(c).over(frame).alias(c) for c in columns])
    else:
        upto, step = ordered([entity], [day]).rowsBetween(START, 0), ordered([entity], [day])
        running = wide.select(entity, day, *columns, *[
            e.over(upto).alias(f"{s}_{c}") for c in columns for s, e in (("_s", F.sum(F.coalesce(c, F.lit(0)))), ("_n", F.count(c)))])

        def last_rows(name: str) -> Column:
            return F.lag(name, 1, 0).over(step) - F.lag(name, n + 1, 0).over(step)

        sums = running.select(entity, day, *[last_rows(f"{s}_{c}").alias(f"{s}_{c}") for c in columns for s in ("_s", "_n")]).select(
            entity, day, *[F.when(F.col(f"_n_{c}") > 0, F.col(f"_s_{c}")).alias(c) for c in columns])
    return sums.select(entity, day, *[F.when(F.col(f"ab_{k}") > 0, F.col(f"tb_{k}") / F.col(f"ab_{k}")).alias(f"slg_{k}") for k in kinds])


def rolling_slg_long(long: DataFrame, entity: str, kind: str, day: str, n: int = 200, min_rows: int = 10) -> DataFrame:
    """W7, long: per (entity, category) rows, null below ``min_rows`` earlier rows."""
    frame = rows_before([entity, kind], [day], n)
    enough = F.count(F.lit(1)).over(frame) >= min_rows
    return long.select(
        entity, kind, day, F.when(enough, F.sum("tb").over(frame) / (F.sum("ab").over(frame) + EPS)).alias("slg")
    )


def mix_value(kinds: list[str], default: float = 0.400) -> Column:
    """W8 from ``mix_<kind>`` and ``slg_<kind>``: mix-weighted value over kinds with both known, default else, within [0, 1]."""
    both = {k: F.col(f"mix_{k}").isNotNull() & F.col(f"slg_{k}").isNotNull() for k in kinds}
    top = sum((F.when(both[k], F.col(f"mix_{k}") * F.col(f"slg_{k}")).otherwise(0.0) for k in kinds), F.lit(0.0))
    bottom = sum((F.when(both[k], F.col(f"mix_{k}")).otherwise(0.0) for k in kinds), F.lit(0.0))
    return clip(F.coalesce(F.when(bottom > 0, top / bottom), F.lit(default)), 0.0, 1.0)


def expected_value_vs_mix(
    games: DataFrame, mix: DataFrame, slg: DataFrame, entity: str, opponent: str, day: str, kinds: list[str],
    default: float = 0.400,
) -> DataFrame:
    """W8 for game rows, from the mix of the opponent's day and the values of the entity's day."""
    joined = games.join(mix, [opponent, day], "left").join(slg, [entity, day], "left")
    return joined.select(*games.columns, mix_value(kinds, default).alias("exp_slg_vs_mix"))


def pair_expanding_lagged(pairs: DataFrame, keys: list[str], day: str, recent: int = 5) -> DataFrame:
    """Cumulative attempts and hits, expanding means of daily means, last-``recent`` sums; all before the row."""
    before, last = all_before(keys, [day]), rows_before(keys, [day], recent)

    def zero(column):
        return F.coalesce(column, F.lit(0))

    return pairs.select(
        "*",
        zero(F.sum("pa").over(before)).alias("cumulative_pa"), zero(F.sum("hr").over(before)).alias("cumulative_hr"),
        F.avg(F.col("ev_sum") / F.nullif(F.col("ev_n"), F.lit(0))).over(before).alias("cumulative_ev"),
        F.avg(F.col("la_sum") / F.nullif(F.col("la_n"), F.lit(0))).over(before).alias("cumulative_la"),
        zero(F.sum("pa").over(last)).alias("recent_pa"), zero(F.sum("hr").over(last)).alias("recent_hr"),
    )


def matchup_features(
    games: DataFrame, pairs: DataFrame, keys: list[str], day: str, recent: int = 5, legacy_double_lag: bool = False,
) -> DataFrame:
    """Pair history as of each game (strictly earlier days).

    ``legacy_double_lag`` leaves the newest earlier row itself out of the sums.
    """
    if legacy_double_lag:
        history = pair_expanding_lagged(pairs, keys, day, recent)
    else:
        upto = ordered(keys, [day]).rowsBetween(START, 0)
        last = ordered(keys, [day]).rowsBetween(-(recent - 1), 0)
        history = pairs.select(
            *keys, day, F.sum("pa").over(upto).alias("cumulative_pa"), F.sum("hr").over(upto).alias("cumulative_hr"),
            F.avg(F.col("ev_sum") / F.nullif(F.col("ev_n"), F.lit(0))).over(upto).alias("cumulative_ev"),
            F.avg(F.col("la_sum") / F.nullif(F.col("la_n"), F.lit(0))).over(upto).alias("cumulative_la"),
            F.sum("pa").over(last).alias("recent_pa"), F.sum("hr").over(last).alias("recent_hr"),
        )
    values = ["cumulative_pa", "cumulative_hr", "cumulative_ev", "cumulative_la", "recent_pa", "recent_hr"]
    found = asof_join(games, history, keys, day, values, year_days=365)

    def number(name: str):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    return found.select(
        *games.columns,
        number("cumulative_pa").alias("matchup_pa_career"), number("cumulative_hr").alias("matchup_hr_career"),
        (number("cumulative_hr") / F.greatest(number("cumulative_pa"), F.lit(1.0))).alias("matchup_hr_rate_career"),
        number("cumulative_ev").alias("matchup_avg_ev_career"), number("cumulative_la").alias("matchup_avg_la_career"),
        number("recent_pa").alias("matchup_pa_recent"), number("recent_hr").alias("matchup_hr_recent"),
        (number("recent_hr") / F.greatest(number("recent_pa"), F.lit(1.0))).alias("matchup_hr_rate_recent"),
        F.coalesce(F.col("days_since_last").cast("double"), F.lit(999.0)).alias("matchup_days_since_last"),
        F.col("rows_last_year").cast("double").alias("matchup_encounters_last_year"),
        F.least(number("cumulative_pa") / 20, F.lit(1.0)).alias("matchup_familiarity_score"),
    )
