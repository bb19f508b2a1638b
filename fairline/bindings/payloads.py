"""S family: tables and payloads are derived from orders and lineitem, written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fairline.bindings.aggregates import PROFILE, SIMILAR, profile
from fairline.bindings.frames import LI, li
from fairline.bindings.joins import GAME_DAYS, WEATHER, WX_SPEC, game_days, weather
from fairline.bindings.registry import query, table
from fairline.functions.durable import materialise, shared_folder
from fairline.operators import aggregate as A
from fairline.sources import payload as P
from fairline.sources import store as K
from fairline.sources import tables as T


def folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def pitch_rows(rows):
    """lineitem in the shape of an event feed (a few optional columns only)."""
    return rows.select(
        F.col("day").alias("game_date"), F.when(F.col("hand") == "N", "S").otherwise("R").alias("game_type"),
        F.concat(F.lit("H"), "park").alias("home_team"), F.concat(F.lit("A"), "opp").alias("away_team"), F.col("l_orderkey").alias("game_pk"), "inning",
        F.when(F.col("inning") % 2 == 0, "Top").otherwise("Bot").alias("inning_topbot"),
        F.when(F.col("hit") == 1, "home_run").when(F.col("att") == 1, "field_out").alias("events"), F.col("ent").alias("batter"), F.col("cust").alias("pitcher"),
        F.when(F.col("x") > 25, "R").otherwise("L").alias("p_throws"), F.lit("R").alias("stand"), F.substring("kind", 1, 2).alias("pitch_type"),
        F.col("speed").cast("double").alias("release_speed"), F.col("x").alias("launch_speed"))


@query("s1_read_pitch_events", "batter:l date:d season:i bat_team:s is_pa:l is_hr:l launch_speed:f launch_angle:f", f"""
WITH {LI} SELECT ent AS batter, day AS date, CASE WHEN month(day) <= 2 THEN year(day) - 1 ELSE year(day) END AS season, CASE WHEN inning % 2 = 0 THEN 'A' || opp ELSE 'H' || park END AS bat_team,
  count(*) FILTER (hit = 1 OR att = 1) AS is_pa, sum(hit) AS is_hr, avg(x) AS launch_speed, NULL AS launch_angle FROM li
WHERE hand <> 'N' AND day BETWEEN DATE '1997-03-01' AND DATE '1999-10-31' GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    path = folder(spark)
    feed = pitch_rows(li(spark, sf))
    feed.withColumn("year", F.year("game_date")).write.partitionBy("year").parquet(path)
    events = T.read_pitch_events(spark, path, "1997-03-01", "1999-10-31")
    return events.groupBy("batter", "date", "season", "bat_team").agg(
        F.sum("is_pa").alias("is_pa"), F.sum("is_hr").alias("is_hr"), F.avg("launch_speed").alias("launch_speed"), F.avg("launch_angle").alias("launch_angle"))


DAYS = "SELECT o_custkey AS player, CAST(o_orderdate AS DATE) AS date, year(o_orderdate) AS season, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2, 3"


def dataset(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("player"), d.alias("date"), F.year(d).alias("season")).agg(F.sum("o_totalprice").alias("total"))


@query("s2_dataset_parquet", "player:l date:d season:i total:g", DAYS)
def _(spark, sf):
    path = folder(spark)
    T.save_dataset(dataset(spark, sf), path, "pregame_dataset_a")
    return T.load_dataset(spark, path, "pregame_dataset_a")


@query("s2_dataset_csv", "player:l date:d season:i total:g", DAYS)
def _(spark, sf):
    path = folder(spark)
    T.save_dataset(dataset(spark, sf), path, "pregame_dataset_b", "csv", partition=None)
    return T.load_dataset(spark, path, "pregame_dataset_b", "csv", "player bigint, date string, season int, total double")


@query("s3_read_weather_csv", "ent:l stadium:s date:d hr:l " + WX_SPEC, f"""
WITH {LI}, {WEATHER}, {GAME_DAYS} SELECT ent, 'P' || stadium AS stadium, date, hr, temperature, wind_speed, wind_direction, humidity, pressure FROM gd LEFT JOIN wx USING (date, stadium)""")
def _(spark, sf):
    # games and weather read the joined lines, so they are written once
    rows, path = materialise(li(spark, sf).select("ent", "park", "day", "l_orderkey", "inning", "speed", "hit", "x")), folder(spark)
    named = weather(rows).select("date", F.concat(F.lit("P"), "stadium").alias("stadium"), "temperature", "wind_speed", "wind_direction", "humidity", "pressure")
    named.write.option("header", True).csv(path)
    games = game_days(rows).withColumn("stadium", F.concat(F.lit("P"), "stadium"))
    return T.attach_weather_csv(games, T.read_weather_csv(spark, path))


@query("s4_read_dataset_union", "player:l date:d total:g note:s", f"""
WITH x AS ({DAYS}), a AS (SELECT * FROM x WHERE season <= 1998), b AS (SELECT *, 'newer' AS note FROM x WHERE season >= 1997)
SELECT player, date, total + 1 AS total, note FROM b UNION ALL SELECT player, date, total, NULL FROM a WHERE season < 1997""")
def _(spark, sf):
    rows, path = dataset(spark, sf), folder(spark)
    rows.where("season <= 1998").write.parquet(f"{path}/pregame_dataset_1.parquet")
    rows.where("season >= 1997").withColumns({"total": F.col("total") + 1, "note": F.lit("newer")}).write.parquet(f"{path}/pregame_dataset_2.parquet")
    return T.read_dataset_union(spark, f"{path}/pregame_dataset_*.parquet", ["player", "date"])


@query("s4_read_dataset_union_all", "player:l n:l", f"""
WITH x AS ({DAYS}) SELECT player, count(*) AS n FROM (SELECT player FROM x WHERE season <= 1998 UNION ALL SELECT player FROM x WHERE season >= 1997) GROUP BY 1""")
def _(spark, sf):
    rows, path = dataset(spark, sf), folder(spark)
    rows.where("season <= 1998").write.parquet(f"{path}/pregame_dataset_1.parquet")
    rows.where("season >= 1997").write.parquet(f"{path}/pregame_dataset_2.parquet")
    return T.read_dataset_union(spark, f"{path}/pregame_dataset_*.parquet").groupBy("player").agg(F.count(F.lit(1)).alias("n"))


@query("s5_write_snapshot", "player:l date:d total:g", DAYS)
def _(spark, sf):
    _, latest = T.write_snapshot(dataset(spark, sf), folder(spark), "recent_data", "2024-10-01")
    return spark.read.parquet(latest)


def odds_payload(spark, sf):
    """One nested odds event per order, a bookmaker per line; a line's fields vary like real feeds'."""
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Player, Nr "), "l_partkey")).otherwise(F.concat(F.lit(" Nr "), "l_partkey", F.lit(" Player")))
    none = F.lit(None).cast("string")

    def outcome(side, price):
        return F.struct(F.lit(side).alias("name"), F.when(F.col("l_linenumber") != 3, name).alias("description"), F.when(F.col("l_linenumber") == 3, name).alias("participant"),
                        price.alias("price"), F.when(F.col("l_linenumber") == 5, 1.5).otherwise(0.5).alias("point"))

    book = F.struct(
        F.when(F.col("l_returnflag") != "A", F.concat(F.lit("bk_"), "l_returnflag")).alias("key"), F.when(F.col("l_returnflag") == "A", F.lit("bk_A")).otherwise(none).alias("title"),
        F.array(F.struct(F.when(F.col("l_linenumber") == 6, "strikeouts").otherwise("batter_home_runs").alias("key"),
                         F.array(outcome("Over", 100 + F.col("l_quantity")), outcome("Under", -F.col("l_quantity") - 100)).alias("outcomes"))).alias("markets"))
    lines = table(spark, sf, "lineitem").withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag"))
    books = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", book.alias("b")))), lambda v: v["b"]).alias("bookmakers"))
    return books.select("l_orderkey", F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("id"), "bookmakers")).alias("payload"))


@query("s6_flatten_odds_json", "l_orderkey:l bookmaker:s player:s over:f under:f", """
SELECT l_orderkey, 'bk_' || l_returnflag AS bookmaker, 'Nr ' || l_partkey || ' Player' AS player, arg_max(100 + l_quantity, (l_linenumber, l_quantity)) AS over,
  arg_max(-100 - l_quantity, (l_linenumber, l_quantity)) AS under FROM lineitem WHERE l_linenumber NOT IN (5, 6) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return P.flatten_odds_json(odds_payload(spark, sf), "payload", ["l_orderkey"])


@query("s7_filter_events_local_date", "event_id:l user_id:l", """
SELECT event_id, user_id FROM events WHERE CAST(ts - INTERVAL 5 HOUR AS DATE) = DATE '2024-01-10'""")
def _(spark, sf):
    rows = table(spark, sf, "events").withColumn("start", F.col("ts"))
    return P.filter_events_local_date(rows, "start", "America/New_York", F.lit("2024-01-10").cast("date"))


@query("s8_flatten_schedule_json", "game_pk:l date:d side:s starter:l starter_name:s", """
WITH g AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_custkey, o_orderstatus FROM orders)
SELECT o_orderkey AS game_pk, date, 'home' AS side, o_custkey AS starter, 'P ' || o_custkey AS starter_name FROM g WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, date, 'away', o_custkey + 1, 'P ' || (o_custkey + 1) FROM g WHERE o_orderstatus <> 'F'""")
def _(spark, sf):
    def starter(key, known):
        p = F.struct(key.alias("id"), F.concat(F.lit("P "), key).alias("fullName"))
        return F.struct(F.when(known, p).alias("probablePitcher"))

    k, s = F.col("o_custkey"), F.col("o_orderstatus")
    game = F.struct(F.col("o_orderkey").alias("gamePk"), F.struct(starter(k, s != "P").alias("home"), starter(k + 1, s != "F").alias("away")).alias("teams"))
    days = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.array(game).alias("games"))
    return P.flatten_schedule_json(days.select(F.to_json(F.struct(F.array(F.struct("date", "games")).alias("dates"))).alias("j")), "j")


@query("s9_reduce_hourly_weather", "user_id:l date:d temperature:f humidity:f wind_speed:f wind_direction:f pressure:f", """
WITH h AS (SELECT user_id, CAST(ts AS DATE) AS date, hour(ts) AS hr, avg(value) AS t, avg(CASE WHEN event_type = 'view' THEN value END) AS m FROM events GROUP BY 1, 2, 3),
d AS (SELECT user_id, date, avg(t) FILTER (hr BETWEEN 19 AND 22) AS t, avg(t) AS dt, avg(m) FILTER (hr BETWEEN 19 AND 22) AS h FROM h GROUP BY 1, 2)
SELECT user_id, date, coalesce(t, dt) AS temperature, coalesce(h, 50) AS humidity, 5 * 2.237 AS wind_speed, 0 AS wind_direction, 29.92 * 0.02953 AS pressure FROM d""")
def _(spark, sf):
    view = F.when(F.col("event_type") == "view", F.col("value"))
    hourly = table(spark, sf, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("temp"), F.avg(view).alias("humidity"))
    hour = F.struct(F.date_format("h", "HH:mm:ss").alias("datetime"), "temp", "humidity")
    days = hourly.groupBy("user_id", F.date_format("h", "yyyy-MM-dd").alias("datetime")).agg(F.avg("temp").alias("temp"), F.collect_list(hour).alias("hours"))
    payload = days.select("user_id", F.to_json(F.struct(F.array(F.struct("datetime", "temp", "hours")).alias("days"))).alias("j"))
    return P.metric_feed_units(P.reduce_hourly_weather(payload, "j", ["user_id"]))


def store_lines(spark, sf):
    """The joined lines, written once: every batch reads them for its pairs, its profiles and its groups."""
    return materialise(li(spark, sf).select("ent", "opp", "day", "speed", "hand", "kind", "att", "hit", "x", "price"))


@query("s10_upsert_matchup_tables", "ent:l opp:l pa:l hr:l ev:f last_date:d", f"""
WITH {LI} SELECT ent, opp, sum(att) AS pa, sum(hit) AS hr, avg(x) AS ev, max(day) AS last_date FROM li GROUP BY 1, 2""")
def _(spark, sf):
    rows, path = store_lines(spark, sf), folder(spark)
    shapes = profile(rows)
    for part in ("day < DATE '1998-06-01'", "day >= DATE '1998-06-01'"):
        batch = rows.where(part)
        K.upsert_matchup_tables(spark, path, K.matchup_increment(batch, "ent", "opp", "day", "att", "hit", "x", "price"), shapes,
                                A.similarity_stats(batch, shapes, "ent", "opp", "att", "hit"), "ent", "opp")
    return K.read_version(spark, f"{path}/matchups").withColumn("ev", F.col("ev_sum") / F.col("ev_n"))


@query("s10_similarity_store", "ent:l group_type:s group_value:s pa:l hr:l hr_rate:f", f"WITH {LI}, {PROFILE}, {SIMILAR} SELECT *, hr / pa AS hr_rate FROM sim")
def _(spark, sf):
    rows, path = store_lines(spark, sf), folder(spark)
    shapes = profile(rows)
    for part in ("day < DATE '1997-02-01'", "day >= DATE '1997-02-01'"):
        batch = rows.where(part)
        K.upsert_matchup_tables(spark, path, K.matchup_increment(batch, "ent", "opp", "day", "att", "hit", "x", "price"), shapes,
                                A.similarity_stats(batch, shapes, "ent", "opp", "att", "hit"), "ent", "opp")
    return K.read_version(spark, f"{path}/similarity")


@query("s10_similarity_retraction", "ent:l group_type:s group_value:s pa:l hr:l", f"WITH {LI}, {PROFILE}, {SIMILAR} SELECT * FROM sim")
def _(spark, sf):
    """Profiles are known better with each batch; totals follow the opponents that change their group."""
    rows, path = store_lines(spark, sf), folder(spark)
    ends = ["day < DATE '1993-06-01'", "day >= DATE '1993-06-01' AND day < DATE '1997-02-01'", "day >= DATE '1997-02-01'"]
    for i, part in enumerate(ends):
        batch, seen = rows.where(part), rows.where(" OR ".join(f"({p})" for p in ends[: i + 1]))
        shapes = profile(seen)
        K.upsert_matchup_tables(spark, path, K.matchup_increment(batch, "ent", "opp", "day", "att", "hit", "x", "price"), shapes,
                                A.similarity_stats(batch, shapes, "ent", "opp", "att", "hit"), "ent", "opp")
    return K.read_version(spark, f"{path}/similarity").where("pa > 0")


@query("s11_append_insert_or_ignore", "game_id:s player_name:s hits:l", """
WITH p AS (SELECT strftime(l_shipdate, '%Y-%m-%d') || '_H' || l_suppkey || '_A' || l_orderkey AS game_id, CASE WHEN l_linenumber = 4 THEN '' ELSE 'part ' || l_partkey END AS player_name,
  CAST(l_quantity AS BIGINT) AS hits, CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT game_id, player_name, min(hits) AS hits FROM p WHERE player_name <> '' GROUP BY 1, 2 HAVING max(CASE WHEN day < DATE '1996-01-01' THEN 1 ELSE 0 END) = 0""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").alias("day"), F.concat(F.lit("H"), "l_suppkey").alias("home"), F.concat(F.lit("A"), "l_orderkey").alias("away"),
        F.when(F.col("l_linenumber") == 4, " ").otherwise(F.concat(F.lit("part "), "l_partkey")).alias("player_name"), F.col("l_quantity").cast("bigint").alias("hits"))
    rows = lines.select(K.game_id("day", "home", "away").alias("game_id"), "player_name", "hits", "day")
    keys = ["game_id", "player_name"]
    stored = K.insert_or_ignore(None, rows.where("day < DATE '1996-01-01'"), keys, "player_name")
    return K.insert_or_ignore(stored, rows.drop("day"), keys, "player_name")


@query("s12_export_ledger_csv", "bet_id:l date:d stake:g", "SELECT o_orderkey AS bet_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS stake FROM orders")
def _(spark, sf):
    path = folder(spark)
    bets = table(spark, sf, "orders").select(F.col("o_orderkey").alias("bet_id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("stake"))
    T.export_ledger_csv(bets, path)
    return spark.read.csv(path, header=True, schema="bet_id bigint, date date, timestamp string, stake double")


@query("s12_export_sample", "o_orderkey:l total:g")
def _(spark, sf):
    path = folder(spark)
    T.export_sample(table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("total")), path, keys=["o_orderkey"])
    return spark.read.csv(path, header=True, schema="o_orderkey bigint, total double")


@query("s12_export_recent_json", "event_id:l value:f", "SELECT event_id, value FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 48 HOUR")
def _(spark, sf):
    path = folder(spark)
    T.export_recent_json(table(spark, sf, "events").select("event_id", "ts", "value"), path, "ts", 48)
    return spark.read.schema("event_id bigint, value double").json(path)
