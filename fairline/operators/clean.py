"""Projections, filters and cleaning (P family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairline import schema
from fairline.functions.columns import clip, first_matching, flag, numeric_columns, one_row
from fairline.functions.ordering import quantile_row


def derive_event_flags(
    df: DataFrame, outcome: str = "events", hit_value: str = "home_run", time: str = "game_date",
    half: str | None = "inning_topbot", home: str = "home_team", away: str = "away_team",
) -> DataFrame:
    """attempt/hit flags, batting side, midnight date and season of raw events."""
    out = df.select(
        "*",
        flag(F.col(outcome).isNotNull()).alias("is_pa"),
        flag(F.col(outcome) == hit_value).alias("is_hr"),
        F.to_date(time).alias("date"),
    ).withColumn("season", season_of(F.col("date")))
    if half and half in df.columns:
        out = out.withColumn("bat_team", F.when(F.col(half) == "Top", F.col(away)).otherwise(F.col(home)))
    return out


def filter_regular_season(df: DataFrame, column: str = "game_type", value: str = "R") -> DataFrame:
    """Keep one kind of rows if the column exists."""
    return df.where(F.col(column) == value) if column in df.columns else df


def normalise_dates(df: DataFrame, column: str = "date", fallback: str | None = "game_date") -> DataFrame:
    """Coerce to a date, drop rows that do not parse."""
    source = column if column in df.columns else fallback
    if source is None or source not in df.columns:
        raise ValueError(f"no date column among {df.columns}")
    kind = df.schema[source].dataType
    parsed = F.to_date(F.try_to_timestamp(F.col(source))) if isinstance(kind, T.StringType) else F.to_date(source)
    return df.withColumn(column, parsed).where(F.col(column).isNotNull())


def season_of(date: Column, legacy: bool = False) -> Column:
    """Season year. January/February belong to the year before; ``legacy`` moves Nov/Dec back too."""
    late = F.month(date) >= 11
    early = F.month(date) <= 2
    back = (early | late) if legacy else early
    return (F.year(date) - F.when(back, 1).otherwise(0)).cast("int")


def is_valid_game_date(date: Column) -> Column:
    """Month within March to October."""
    return F.month(date).between(3, 10)


def lookback_range(date: Column, days: int) -> tuple[Column, Column]:
    """``[date - days, date]``."""
    return F.date_sub(date, days), date


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """P5: fail while planning if columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def _finite(column: str) -> Column:
    value = F.col(column)
    bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(~bad, value)


def finite_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities become null."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({c: _finite(c) for c in columns if c in doubles})


def column_medians(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row of medians; ``approximate`` uses mergeable sketches in a single pass."""
    clean = finite_columns(df, columns)
    if approximate:
        return clean.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 100000).alias(c) for c in columns])
    return quantile_row(clean, {c: (c, 0.5) for c in columns})


def impute_median(
    df: DataFrame, columns: list[str] | None = None, exclude: tuple[str, ...] = (), fitted: DataFrame | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Non-finite and null values become the column median, an all-null column 0. Ids go in ``exclude``.

    ``fitted`` passes medians of a training set so nothing leaks from the scored rows.
    """
    chosen = columns or numeric_columns(df, exclude)
    medians = one_row(fitted if fitted is not None else column_medians(df, chosen, approximate), cut=True)
    clean = finite_columns(df, chosen)
    return clean.withColumns({
        c: F.coalesce(F.col(c).cast("double"), medians[c], F.lit(0.0)) for c in chosen
    })


def winsorise(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip a column to its own quantiles."""
    bounds = one_row(quantile_row(df, {"lo": (column, low), "hi": (column, high)}))
    value = F.col(column)
    return df.withColumn(column, F.when(value.isNotNull(), F.least(F.greatest(value, bounds["lo"]), bounds["hi"])))


def clip_rate_columns(df: DataFrame, columns: list[str], high: float = 0.25, low: float = 0.0) -> DataFrame:
    """Bound an explicit list of rate columns."""
    return df.withColumns({c: clip(F.col(c), low, high) for c in columns if c in df.columns})


def fixed_dimension(spark: SparkSession, values: dict, key: str, value: str) -> DataFrame:
    """A lookup table from a fixed dict; its size is known, so it may be broadcast."""
    kind = "double" if isinstance(next(iter(values.values())), float) else "string"
    return F.broadcast(spark.createDataFrame(list(values.items()), f"{key} string, {value} {kind}"))


def map_dimension(df: DataFrame, dimension: DataFrame, on: str, defaults: dict) -> DataFrame:
    """Attach dimension columns by key with defaults for unknown keys."""
    return df.join(dimension, on, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def attach_park(df: DataFrame, team: str = "home_team") -> DataFrame:
    """P9 with the fixed stadium and park-factor tables."""
    spark = df.sparkSession
    stadiums = fixed_dimension(spark, schema.TEAM_STADIUM, team, "stadium")
    factors = fixed_dimension(spark, schema.PARK_FACTOR, "stadium", "park_factor")
    return map_dimension(df.join(stadiums, team, "left"), factors, "stadium", {"park_factor": 1.0})


def derive_opponent(df: DataFrame, home: str, away: str, side: str, out: str = "opp_team") -> DataFrame:
    """P10: the other team."""
    return df.withColumn(out, F.when(F.col(side) == F.col(home), F.col(away)).otherwise(F.col(home)))


def select_available(df: DataFrame, wanted: list[str]) -> DataFrame:
    """An ordered list, as far as present."""
    return df.select(*[c for c in wanted if c in df.columns])


def standardise_name(column: Column) -> Column:
    """Null to empty, trimmed, ``Last, First`` to ``First Last``."""
    text = F.trim(F.coalesce(column, F.lit("")))
    comma = F.instr(text, ",")
    last = F.trim(F.substring_index(text, ",", 1))
    first = F.trim(F.substr(text, comma + 1))
    return F.when(comma > 0, F.trim(F.concat_ws(" ", first, last))).otherwise(text)


# League defaults for prediction rows.
LEAGUE_DEFAULTS = {"batting_avg": 0.250, "on_base_pct": 0.250, "slugging_pct": 0.400, "era": 4.50, "whip": 1.30}


def fill_prediction_defaults(
    df: DataFrame, defaults: dict[str, float], median_columns: list[str], zero_columns: list[str],
) -> DataFrame:
    """Fixed defaults, medians or zero for missing values; absent columns are created."""
    absent = {c: F.lit(None).cast("double") for c in [*defaults, *median_columns, *zero_columns] if c not in df.columns}
    full = df.withColumns(absent)
    filled = full.withColumns({
        **{c: F.coalesce(F.col(c), F.lit(float(v))) for c, v in defaults.items()},
        **{c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero_columns},
    })
    return impute_median(filled, median_columns) if median_columns else filled


def align_features(df: DataFrame, order: list[str], ids: list[str], minimum: int = 20, numeric_instead: bool = False) -> DataFrame:
    """Model column order, missing as 0.

    Fewer than ``minimum`` known features is an error, or with ``numeric_instead`` means every numeric non-id column.
    """
    known = [c for c in order if c in df.columns]
    if len(known) < minimum:
        if not numeric_instead:
            raise ValueError(f"only {len(known)} of the model's features are there, {minimum} are needed")
        order = numeric_columns(df, tuple(ids))
    return df.select(*ids, *[
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c) for c in order
    ])


def drop_feature_list(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Drop listed columns, telling which existed and which did not."""
    existing = [c for c in columns if c in df.columns]
    return df.drop(*existing), existing, [c for c in columns if c not in df.columns]


# Right-closed bins.
BINS = {
    "temperature": ([0, 60, 75, 85, 120], ["cold", "cool", "warm", "hot"]),
    "wind": ([0, 5, 10, 15, 50], ["calm", "light", "moderate", "strong"]),
    "favorability": ([0, 0.9, 1.1, 2.0], ["unfavorable", "neutral", "favorable"]),
    "velocity": ([0, 90, 94, 100], ["low", "medium", "high"]),
    "test_temperature": ([0, 60, 70, 80, 90, 120], ["<60", "60-70", "70-80", "80-90", ">90"]),
}


def bin_column(column: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins; values outside every bin are null."""
    return first_matching([
        ((column > lo) & (column <= hi), F.lit(label)) for lo, hi, label in zip(edges, edges[1:], labels)
    ])


def categorise_direction(degrees: Column) -> Column:
    """Favourable, unfavourable or neutral wind direction."""
    return first_matching(
        [(degrees.between(45, 135), F.lit("favorable")), (degrees.between(225, 315), F.lit("unfavorable"))], F.lit("neutral")
    )


def filter_last_days(df: DataFrame, date: str, days: int, end: str | None = None) -> DataFrame:
    """Rows of the last days; the newest date is a scalar subquery, so partitions can be pruned."""
    last = F.lit(end).cast("date") if end else df.agg(F.max(date).alias("last")).scalar()
    return df.where((F.col(date) >= F.date_sub(last, days)) & (F.col(date) <= last))


def slice_target_date(df: DataFrame, date: str, target: str) -> DataFrame:
    """Keep one day of a table built over its lookback range."""
    return df.where(F.col(date) == F.lit(target).cast("date"))


def infer_game_hour(date: Column, start: Column | None = None) -> Column:
    """P20: actual start hour, else weekend 13, weekday 19, weekday of June to August 20."""
    weekend = F.dayofweek(date).isin(1, 7)
    guess = first_matching([(weekend, F.lit(13)), (F.month(date).between(6, 8), F.lit(20))], F.lit(19))
    return guess if start is None else F.coalesce(F.hour(start), guess)
