"""Joins, as-of lookups and look-back totals (J family).

Sides are never force-broadcast here: Spark's size threshold and adaptive
execution choose the strategy, and adaptive skew handling splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.columns import day_number, one_row
from fairline.functions.parallel import dealt_out
from fairline.functions.windows import all_before
from fairline.operators.clean import standardise_name


def join_starters(games: DataFrame, starters: DataFrame, game: str, opponent_team: str, defending_team: str) -> DataFrame:
    """Starter of the opposing side, null if unknown."""
    return games.join(starters.withColumnRenamed(defending_team, opponent_team), [game, opponent_team], "left")


def join_pitcher_profiles(games: DataFrame, opponent_days: DataFrame, starter: str, opponent: str, day: str) -> DataFrame:
    """Opponent-day features by (starter, day)."""
    return games.join(opponent_days.withColumnRenamed(opponent, starter), [starter, day], "left")


def join_names(df: DataFrame, register: DataFrame, id_column: str, key: str, first: str, last: str, out: str = "name") -> DataFrame:
    """``first last`` from a register; ids that are not whole numbers and empty names give null."""
    names = register.select(
        F.col(key).cast("bigint").alias("_id"),
        F.nullif(F.trim(F.concat_ws(" ", F.trim(first), F.trim(last))), F.lit("")).alias(out),
    )
    ids = df.withColumn("_id", F.col(id_column).try_cast("bigint"))
    return ids.join(names, "_id", "left").drop("_id")


def join_pivoted_splits(games: DataFrame, wide: DataFrame, entity: str, day: str) -> DataFrame:
    """The wide split table of one aggregation, attached with one left join."""
    return games.join(wide, [entity, day], "left")


def asof_join(
    games: DataFrame, history: DataFrame, keys: list[str], day: str, values: list[str], year_days: int = 365,
) -> DataFrame:
    """Last history row with an earlier day, its distance, and how many lie within ``year_days``.

    The distinct (keys, day) of the games and the history are stacked and read
    with a range frame that ends one day back: equal days never match, and a
    window partition holds at most two rows per calendar day.
    """
    asked = games.select(*keys, day).distinct().withColumn("_asked", F.lit(True))
    past = history.select(*keys, day, *values, F.lit(False).alias("_asked"), F.col(day).alias("_seen"))
    stacked = asked.unionByName(past, allowMissingColumns=True).withColumn("_dn", day_number(day))
    window = Window.partitionBy(*keys).orderBy("_dn")
    earlier = window.rangeBetween(Window.unboundedPreceding, -1)
    found = stacked.select(
        *keys, day, "_asked",
        F.last(F.when(~F.col("_asked"), F.struct("_seen", *values)), ignorenulls=True).over(earlier).alias("_last"),
        F.count("_seen").over(window.rangeBetween(-year_days, -1)).alias("rows_last_year"),
    ).where("_asked")
    answers = found.select(
        *keys, day, *[F.col("_last")[v].alias(v) for v in values],
        F.datediff(F.col(day), F.col("_last")["_seen"]).alias("days_since_last"), "rows_last_year",
    )
    return games.join(answers, [*keys, day], "left")


def totals_before(
    games: DataFrame, facts: DataFrame, keys: list[str], day: str, sums: dict[str, str], days: int | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Per (keys, day) of ``games``: totals of earlier days, all of them or the last ``days``.

    Facts and games collapse to one row per (keys, day) before the window, so
    its partitions are bounded by the calendar. ``parts`` is the number of tasks
    to deal them out to (see ``dealt_out``).
    """
    zero = games.select(*keys, day, *[F.lit(0).alias(n) for n in sums])
    stacked = facts.select(*keys, day, *[F.col(c).alias(n) for n, c in sums.items()]).unionByName(zero)
    stacked = dealt_out(stacked, parts, *keys, day)
    daily = stacked.groupBy(*keys, day).agg(*[F.sum(n).alias(n) for n in sums]).withColumn("_dn", day_number(day))
    daily = dealt_out(daily, parts, *keys)
    if days is None:
        frame = all_before(keys, ["_dn"])
    else:
        frame = Window.partitionBy(*keys).orderBy("_dn").rangeBetween(-days, -1)
    return daily.select(*keys, day, *[F.coalesce(F.sum(n).over(frame), F.lit(0)).alias(n) for n in sums])


def lookback_range_join(
    games: DataFrame, events: DataFrame, entity: str, day: str, days: int, sums: dict[str, str], parts: int | None = None,
) -> DataFrame:
    """Totals of the entity's events in ``[d - days, d)`` for every game."""
    totals = totals_before(games, events, [entity], day, sums, days, parts)
    return dealt_out(games, parts, entity, day).join(dealt_out(totals, parts, entity, day), [entity, day], "left")


def similar_group_history(
    games: DataFrame, pairs: DataFrame, profiles: DataFrame, entity: str, opponent: str, day: str,
) -> DataFrame:
    """Earlier attempts and hits against *other* opponents of the same hand and of the same speed tier.

    Games and pair days are stacked and shuffled once, by the entity; three range frames that end one day back give the
    totals of the opponent, the hand and the tier. Game columns ride along, so nothing is exploded or joined back. What
    one task holds of an entity is bounded by its opponents and the calendar, and sorts and frames spill.
    ``profiles`` has one row per opponent.
    """
    shape = profiles.select(opponent, "handedness", "velocity_tier")
    groups = {"own": opponent, "hand": "handedness", "velocity": "velocity_tier"}
    keys = [F.col(c).alias(f"_{k}") for k, c in groups.items()]
    facts = pairs.join(shape, opponent).select(F.col(entity).alias("_entity"), *keys, day_number(day).alias("_dn"), "pa", "hr")
    asked = games.join(shape, opponent, "left").select(
        F.col(entity).alias("_entity"), *keys, day_number(day).alias("_dn"), F.struct(*games.columns).alias("_game"))
    stacked = facts.unionByName(asked, allowMissingColumns=True).repartition("_entity")

    def before(kind: str, measure: str):
        frame = Window.partitionBy("_entity", f"_{kind}").orderBy("_dn").rangeBetween(Window.unboundedPreceding, -1)
        known = F.col("_entity").isNotNull() & F.col(f"_{kind}").isNotNull() & F.col("_dn").isNotNull()
        return F.when(known, F.coalesce(F.sum(measure).over(frame), F.lit(0)))

    found = stacked.select("_game", *[before(k, m).alias(f"_{k}_{m}") for k in groups for m in ("pa", "hr")]).where("_game is not null")
    terms = {}
    for label in ("hand", "velocity"):
        pa, hr = (F.coalesce(F.col(f"_{label}_{m}") - F.col(f"_own_{m}"), F.lit(0)) for m in ("pa", "hr"))
        terms |= {f"vs_similar_{label}_pa": pa, f"vs_similar_{label}_hr": hr, f"vs_similar_{label}_hr_rate": hr / F.greatest(pa, F.lit(1))}
    return found.select("_game.*", *[c.alias(n) for n, c in terms.items()])


def similar_group_cutoff(
    games: DataFrame, pairs: DataFrame, profiles: DataFrame, entity: str, opponent: str, day: str, cutoff: str,
) -> DataFrame:
    """Totals per entity and hand / tier up to one cutoff day, looked up by the opponent's profile."""
    shape = profiles.select(opponent, "handedness", "velocity_tier")
    past = pairs.where(F.col(day) <= F.lit(cutoff).cast("date")).groupBy(entity, opponent).agg(
        F.sum("pa").alias("pa"), F.sum("hr").alias("hr")).join(shape, opponent)
    out = games.join(shape, opponent, "left")
    for label, group in (("hand", "handedness"), ("velocity", "velocity_tier")):
        totals = past.groupBy(entity, group).agg(
            F.sum("pa").alias(f"vs_similar_{label}_pa"), F.sum("hr").alias(f"vs_similar_{label}_hr"))
        out = out.join(totals, [entity, group], "left")
        pa, hr = (F.coalesce(F.col(f"vs_similar_{label}_{m}"), F.lit(0)) for m in ("pa", "hr"))
        out = out.withColumns({
            f"vs_similar_{label}_pa": pa, f"vs_similar_{label}_hr": hr,
            f"vs_similar_{label}_hr_rate": hr / F.greatest(pa, F.lit(1)),
        })
    return out.drop("handedness", "velocity_tier")


# Weather used where a feed has none.
WEATHER_DEFAULTS = {"temperature": 72.0, "wind_speed": 5.0, "wind_direction": 0.0, "humidity": 50.0, "pressure": 29.92}


def join_weather(games: DataFrame, weather: DataFrame, day: str = "date", place: str = "stadium") -> DataFrame:
    """Weather by (date, stadium), by date alone if either side has no stadium; defaults for gaps."""
    if place in games.columns and place in weather.columns:
        joined = games.join(weather, [day, place], "left")
    else:
        daily = weather.groupBy(day).agg(*[F.avg(c).alias(c) for c in WEATHER_DEFAULTS])
        joined = games.join(daily, day, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in WEATHER_DEFAULTS.items()})


def accept_feed(feed: DataFrame, fallback: DataFrame, minimum: float = 0.5) -> DataFrame:
    """The feed if more than half its rows carry all five values, else the fallback table."""
    complete = F.lit(True)
    for c in WEATHER_DEFAULTS:
        complete = complete & F.col(c).isNotNull()
    share = one_row(feed.agg(F.avg(complete.cast("int")).alias("share")))["share"]
    good = F.coalesce(share > minimum, F.lit(False))
    return feed.where(good).unionByName(fallback.where(~good), allowMissingColumns=True)


def join_odds(predictions: DataFrame, odds: DataFrame, day: str, name: str, quote_columns: list[str], bookmaker: str) -> DataFrame:
    """Quotes by (date, standardised name); inline quotes are kept as they are; a name clash goes to the odds side."""
    if all(c in predictions.columns for c in quote_columns):
        out = predictions
    else:
        left = predictions.drop(*[c for c in quote_columns if c in predictions.columns], bookmaker)
        right = odds.select(day, standardise_name(F.col(name)).alias("_std"), *quote_columns, bookmaker)
        out = left.withColumn("_std", standardise_name(F.col(name))).join(right, [day, "_std"], "left").drop("_std")
    missing = F.lit("No Odds Available")
    known = F.col(bookmaker) if bookmaker in out.columns else F.lit(None).cast("string")
    return out.withColumn(bookmaker, F.coalesce(known, missing))


def join_odds_by_name(rows: DataFrame, odds: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Quotes by name only."""
    right = odds.select(standardise_name(F.col(name)).alias("_std"), *columns)
    return rows.withColumn("_std", standardise_name(F.col(name))).join(right, "_std", "left").drop("_std")


def fold_accents(column):
    """Lower-cased text with common Latin accents removed (option of name matching)."""
    return F.translate(F.lower(column), "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")


def match_names_contains(names: DataFrame, name: str, targets: DataFrame, target: str, accents: bool = False) -> DataFrame:
    """(target, name) pairs where the name contains the target as literal text, ignoring case.

    Every distinct name is expanded to its substrings whose length occurs among
    the targets and equi-joined on the text, so only true matches leave the join.
    """
    norm = fold_accents if accents else F.lower
    wanted = targets.select(F.col(target).alias("target"), norm(F.col(target)).alias("_key")).where(
        F.length("_key") > 0).distinct()
    lengths = wanted.select(F.length("_key").alias("n")).distinct().agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    distinct = names.select(F.col(name).alias("name"), norm(F.col(name)).alias("_text")).distinct()
    sized = distinct.withColumn("_n", F.explode(one_row(lengths)["lengths"])).where(F.col("_n") <= F.length("_text"))
    pieces = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("_text") - F.col("_n") + 1), lambda i: F.substring(F.col("_text"), i, F.col("_n"))
    ))
    return sized.select("name", F.explode(pieces).alias("_key")).join(wanted, "_key").select("target", "name")


def newest_rows(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The newest ``k`` rows per key with their ``rank``; Spark limits each key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def template_rows(rows: DataFrame, matches: DataFrame, name: str, order: list, template: list[str], means: list[str], k: int = 10) -> DataFrame:
    """Per target the newest matching row as template and means of the newest ``k``."""
    matched = rows.join(matches.withColumnRenamed("name", name), name)
    newest = newest_rows(matched, ["target"], order, k)
    return newest.groupBy("target").agg(
        *[F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c) for c in template],
        *[F.avg(c).alias(f"recent_{c}") for c in means], F.count(F.lit(1)).alias("recent_rows"),
    )


def latest_row_match(rows: DataFrame, odds: DataFrame, name: str, order: list, columns: list[str], keep: int = 7) -> DataFrame:
    """The last ``keep`` rows per name; quotes are attached to each name's last row only."""
    last = newest_rows(rows, [name], order, keep)
    quotes = odds.select(name, *columns).withColumn("rank", F.lit(1))
    return last.join(quotes, [name, "rank"], "left")


def rebuild_recent_report(
    games: DataFrame, performances: DataFrame, starters: DataFrame, weather: DataFrame, day: str, first: str, last: str,
) -> DataFrame:
    """Games with performances, opposing starters and weather in a date range, known players only.

    ``is_starter`` restricts what is joined, not which games remain.
    """
    span = games.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    starting = starters.where(F.col("is_starter") == 1).drop("is_starter")
    return (
        span.join(performances, "game_id", "left").where(F.col("player_name").isNotNull())
        .join(starting, "game_id", "left").join(weather, "game_id", "left")
    )


def lookup_matchup_features(
    batch: DataFrame, matchups: DataFrame, profiles: DataFrame, similarity: DataFrame, entity: str, opponent: str,
) -> DataFrame:
    """Stored pair row, opponent profile and both similarity rows per request.

    The two group types are separate equi joins instead of one OR predicate.
    """
    out = batch.join(matchups, [entity, opponent], "left").join(
        profiles.select(opponent, "handedness", "velocity_tier"), opponent, "left")
    for kind, column, label in (("handedness", "handedness", "hand"), ("velocity", "velocity_tier", "velocity")):
        group = similarity.where(F.col("group_type") == kind).select(
            entity, F.col("group_value").alias(column), F.col("pa").alias(f"vs_{label}_pa"),
            F.col("hr").alias(f"vs_{label}_hr"), F.col("hr_rate").alias(f"vs_{label}_hr_rate"))
        out = out.join(group, [entity, column], "left")
    return out


def join_pitch_slg(games: DataFrame, slg: DataFrame, entity: str, day: str) -> DataFrame:
    """Wide per-category value by (entity, day); sides dealt out alike by (entity, day) are not shuffled again."""
    return games.join(slg, [entity, day], "left")
