"""Flattening nested odds, schedule and weather payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline import schema
from fairline.operators.clean import standardise_name
from fairline.operators.join import WEATHER_DEFAULTS


def flatten_odds_json(
    df: DataFrame, column: str, keep: list[str], market: str = "batter_home_runs", point: float = 0.5, tolerance: float = 1e-6,
) -> DataFrame:
    """One row per (kept columns, bookmaker, player) with the over and under price.

    Bookmaker and player names fall back over their alternative fields; the
    last outcome in payload order wins.
    """
    event = df.select(*keep, F.from_json(F.col(column), schema.ODDS_JSON).alias("e"))
    books = event.select(*keep, F.posexplode("e.bookmakers").alias("i", "b"))
    markets = books.select(*keep, "i", F.coalesce("b.key", "b.title", "b.name").alias("bookmaker"), F.posexplode("b.markets").alias("j", "m"))
    offers = markets.where(F.col("m.key") == market).select(*keep, "i", "j", "bookmaker", F.posexplode("m.outcomes").alias("k", "o"))
    rows = offers.where(F.abs(F.col("o.point") - point) <= tolerance).select(
        *keep, "bookmaker", standardise_name(F.coalesce("o.description", "o.participant", "o.name")).alias("player"),
        F.lower("o.name").alias("side"), F.col("o.price").alias("price"), F.struct("i", "j", "k").alias("at"))

    def side(name: str) -> Column:
        mine = F.col("side") == name
        return F.max_by(F.when(mine, F.col("price")), F.when(mine, F.col("at")))

    return rows.groupBy(*keep, "bookmaker", "player").agg(side("over").alias("over"), side("under").alias("under"))


def filter_events_local_date(df: DataFrame, start: str, zone: str, date: Column) -> DataFrame:
    """Events whose UTC start falls on a date of another time zone."""
    local = F.to_date(F.from_utc_timestamp(F.col(start).cast("timestamp"), zone))
    return df.where(local == date)


def flatten_schedule_json(df: DataFrame, column: str) -> DataFrame:
    """(game_pk, date, side, starter id and name), sides without a starter left out."""
    days = df.select(F.explode(F.from_json(F.col(column), schema.SCHEDULE_JSON)["dates"]).alias("d"))
    games = days.select(F.col("d.date").cast("date").alias("date"), F.explode("d.games").alias("g"))
    sides = games.select("date", F.col("g.gamePk").alias("game_pk"), F.explode(F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(f"g.teams.{s}.probablePitcher").alias("p")) for s in ("home", "away")])).alias("s"))
    return sides.where(F.col("s.p.id").isNotNull()).select(
        "game_pk", "date", F.col("s.side").alias("side"), F.col("s.p.id").alias("starter"), F.col("s.p.fullName").alias("starter_name"))


# Payload field -> weather column, unit factors of the second feed.
WEATHER_FIELDS = {"temp": "temperature", "humidity": "humidity", "windspeed": "wind_speed", "winddir": "wind_direction", "pressure": "pressure"}
MPS_TO_MPH, HPA_TO_INHG = 2.237, 0.02953


def reduce_hourly_weather(df: DataFrame, column: str, keep: list[str], first: int = 19, last: int = 22) -> DataFrame:
    """Per day the mean over the evening hours, else the daily value, else the default."""
    days = df.select(*keep, F.explode(F.from_json(F.col(column), schema.WEATHER_JSON)["days"]).alias("d"))
    evening = F.filter(F.col("d.hours"), lambda h: F.substring(h["datetime"], 1, 2).try_cast("int").between(first, last))

    def mean(field: str) -> Column:
        values = F.filter(F.transform(evening, lambda h: h[field]), lambda v: v.isNotNull())
        total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
        return F.when(F.size(values) > 0, total / F.size(values))

    return days.select(*keep, F.col("d.datetime").cast("date").alias("date"), *[
        F.coalesce(mean(f), F.col(f"d.{f}"), F.lit(WEATHER_DEFAULTS[c])).alias(c) for f, c in WEATHER_FIELDS.items()])


def metric_feed_units(df: DataFrame) -> DataFrame:
    """Metres per second to miles per hour and hectopascal to inches of mercury."""
    return df.withColumns({"wind_speed": F.col("wind_speed") * MPS_TO_MPH, "pressure": F.col("pressure") * HPA_TO_INHG})
