"""J family on lineitem, orders, customer and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.bindings.aggregates import PAIR_DAY, PROFILE, SIMILAR, pair_days, profile
from fairline.bindings.frames import BOARD, EV_DAY, LI, ev_day, li, odds_board
from fairline.bindings.registry import query, table
from fairline.functions.durable import materialise
from fairline.functions.parallel import dealt_out, parts_of
from fairline.operators import aggregate as A
from fairline.operators import join as J


@query("j1_join_starters", "l_orderkey:l opp_team:s n:l starter:l", f"""
WITH {LI}, g AS (SELECT l_orderkey, hand AS opp_team, count(*) AS n FROM li GROUP BY 1, 2),
s AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN -l_orderkey ELSE l_orderkey END AS l_orderkey, hand, first(ent ORDER BY inning, day, l_partkey, ent) AS starter FROM li GROUP BY 1, 2)
SELECT g.*, starter FROM g LEFT JOIN s ON g.l_orderkey = s.l_orderkey AND opp_team = hand""")
def _(spark, sf):
    rows = li(spark, sf)
    games = rows.groupBy("l_orderkey", F.col("hand").alias("opp_team")).agg(F.count(F.lit(1)).alias("n"))
    other = rows.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 7 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")))
    starters = A.first_per_group(other, ["l_orderkey", "hand"], "ent",
                                 ["inning", "day", "l_partkey", "ent"], "starter")
    return J.join_starters(games, starters, "l_orderkey", "opp_team", "hand")


@query("j2_join_pitcher_profiles", "ent:l starter:l day:d hr_allowed:l pa_faced:l", f"""
WITH {LI}, g AS (SELECT ent, CASE WHEN opp < 20 THEN opp ELSE opp + 100 END AS starter, day FROM li GROUP BY 1, 2, 3),
o AS (SELECT opp, day, sum(hit) AS hr_allowed, sum(att) AS pa_faced FROM li GROUP BY 1, 2)
SELECT g.*, hr_allowed, pa_faced FROM g LEFT JOIN o ON g.starter = o.opp AND g.day = o.day""")
def _(spark, sf):
    rows = li(spark, sf)
    games = rows.select("ent", F.when(F.col("opp") < 20, F.col("opp")).otherwise(F.col("opp") + 100).alias("starter"), "day").distinct()
    days = A.opponent_day_agg(rows, "opp", "day", "hit", "att", "x", "speed", "kind")
    return J.join_pitcher_profiles(games, days, "starter", "opp", "day")


@query("j3_join_names", "o_orderkey:l name:s", """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN c_mktsegment || ' ' || c_name END AS name FROM orders
LEFT JOIN customer ON o_custkey = CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "unknown").otherwise(F.col("o_custkey").cast("string")).alias("id"))
    register = table(spark, sf, "customer").withColumn("c_custkey", F.expr("CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END"))
    return J.join_names(rows, register, "id", "c_custkey", "c_mktsegment", "c_name")


WIDE = """w AS (SELECT ent, day, sum(att) FILTER (hand = 'R') AS R_pa, sum(att) FILTER (hand = 'A') AS A_pa,
  avg(x) FILTER (hand = 'R') AS R_x, avg(x) FILTER (hand = 'A') AS A_x FROM li GROUP BY 1, 2)"""


@query("j4_join_pivoted_splits", "ent:l day:d n:l R_pa:l A_pa:l R_x:f A_x:f", f"""
WITH {LI}, {WIDE}, g AS (SELECT ent, day, count(*) AS n FROM li GROUP BY 1, 2)
SELECT g.*, R_pa, A_pa, R_x, A_x FROM g LEFT JOIN w USING (ent, day)""")
def _(spark, sf):
    rows = li(spark, sf)
    games = rows.groupBy("ent", "day").agg(F.count(F.lit(1)).alias("n"))
    wide = rows.groupBy("ent", "day").pivot("hand", ["R", "A"]).agg(
        F.sum("att").alias("pa"), F.avg("x").alias("x"))
    return J.join_pivoted_splits(games, wide, "ent", "day")


GAMES = "g AS (SELECT DISTINCT ent, cust % 25 AS opp, day + 3 AS day FROM li)"


def games(rows):
    return rows.select("ent", (F.col("cust") % 25).alias("opp"), F.date_add("day", 3).alias("day")).distinct()


@query("j5_asof_matchup_join", "ent:l opp:l day:d pa:l ev_sum:f days_since_last:l rows_last_year:l", f"""
WITH {LI}, {PAIR_DAY}, {GAMES}
SELECT g.ent, g.opp, g.day, pd.pa, pd.ev_sum, g.day - pd.day AS days_since_last,
  (SELECT count(*) FROM pd q WHERE q.ent = g.ent AND q.opp = g.opp AND q.day < g.day AND q.day >= g.day - 365) AS rows_last_year
FROM g ASOF LEFT JOIN pd ON g.ent = pd.ent AND g.opp = pd.opp AND g.day > pd.day""")
def _(spark, sf):
    return J.asof_join(games(li(spark, sf)), pair_days(spark, sf), ["ent", "opp"], "day", ["pa", "ev_sum"])


@query("j6_lookback_range_join", "ent:l opp:l day:d pa:l hr:l x:f", f"""
WITH {LI}, {GAMES}, e AS (SELECT ent, day, sum(att) AS pa, sum(hit) AS hr, sum(x) AS x FROM li GROUP BY 1, 2),
k AS (SELECT DISTINCT ent, day FROM g), t AS (SELECT k.ent, k.day, coalesce(sum(pa), 0) AS pa, coalesce(sum(hr), 0) AS hr,
  coalesce(sum(x), 0) AS x FROM k LEFT JOIN e ON e.ent = k.ent AND e.day >= k.day - 60 AND e.day < k.day GROUP BY 1, 2)
SELECT g.*, pa, hr, x FROM g JOIN t USING (ent, day)""")
def _(spark, sf):
    # the joined lines are read three times, so they are written once; the number of lines says how many tasks share them
    parts = parts_of(table(spark, sf, "lineitem"))
    rows = materialise(li(spark, sf, parts).select("ent", "cust", "day", "att", "hit", "x"))
    asked = dealt_out(rows.select("ent", (F.col("cust") % 25).alias("opp"), F.date_add("day", 3).alias("day")), parts, "ent", "day").distinct()
    return J.lookback_range_join(asked, rows, "ent", "day", 60, {"pa": "att", "hr": "hit", "x": "x"}, parts)


SIM_COLS = " ".join(f"vs_similar_{g}_{m}" + (":f" if m == "hr_rate" else ":l")
                    for g in ("hand", "velocity") for m in ("pa", "hr", "hr_rate"))


def _similar_sql(label: str, group: str) -> str:
    return f"""s_{label} AS (SELECT g.ent, g.opp, g.day, coalesce(sum(d.pa), 0) AS pa, coalesce(sum(d.hr), 0) AS hr
  FROM gp g LEFT JOIN pp d ON d.ent = g.ent AND d.{group} = g.{group} AND d.opp <> g.opp AND d.day < g.day GROUP BY 1, 2, 3)"""


@query("j7_similar_group_history", "ent:l opp:l day:d " + SIM_COLS, f"""
WITH {LI}, {PROFILE}, {PAIR_DAY}, {GAMES.replace('day + 3', 'last_day(day)')},
pp AS (SELECT * FROM pd JOIN prof USING (opp)), gp AS (SELECT * FROM g JOIN prof USING (opp)),
{_similar_sql('hand', 'handedness')}, {_similar_sql('velocity', 'velocity_tier')}
SELECT h.ent, h.opp, h.day, h.pa AS vs_similar_hand_pa, h.hr AS vs_similar_hand_hr, h.hr / greatest(h.pa, 1) AS vs_similar_hand_hr_rate,
  v.pa AS vs_similar_velocity_pa, v.hr AS vs_similar_velocity_hr, v.hr / greatest(v.pa, 1) AS vs_similar_velocity_hr_rate
FROM s_hand h JOIN s_velocity v ON h.ent = v.ent AND h.opp = v.opp AND h.day = v.day""")
def _(spark, sf):
    # the joined lines are read three times, so they are written once
    rows = materialise(li(spark, sf).select("ent", "cust", "opp", "day", "speed", "hand", "kind", "att", "hit", "x", "price"))
    month_end = rows.select("ent", (F.col("cust") % 25).alias("opp"), F.last_day("day").alias("day")).distinct()
    pairs = A.pair_day_agg(rows, "ent", "opp", "day", "att", "hit", "x", "price")
    return J.similar_group_history(month_end, pairs, profile(rows), "ent", "opp", "day")


def _cut_sql(label: str, group: str) -> str:
    return f"""c_{label} AS (SELECT ent, {group} AS grp, sum(pa) AS pa, sum(hr) AS hr FROM pd JOIN prof USING (opp)
  WHERE day <= DATE '1999-12-31' GROUP BY 1, 2)"""


@query("j8_similar_group_cutoff", "ent:l opp:l day:d " + SIM_COLS, f"""
WITH {LI}, {PROFILE}, {PAIR_DAY}, {GAMES}, {_cut_sql('hand', 'handedness')}, {_cut_sql('velocity', 'velocity_tier')}
SELECT g.ent, g.opp, g.day, coalesce(h.pa, 0) AS vs_similar_hand_pa, coalesce(h.hr, 0) AS vs_similar_hand_hr,
  coalesce(h.hr / greatest(h.pa, 1), 0) AS vs_similar_hand_hr_rate, coalesce(v.pa, 0) AS vs_similar_velocity_pa,
  coalesce(v.hr, 0) AS vs_similar_velocity_hr, coalesce(v.hr / greatest(v.pa, 1), 0) AS vs_similar_velocity_hr_rate
FROM g JOIN prof p USING (opp) LEFT JOIN c_hand h ON h.ent = g.ent AND h.grp = p.handedness
LEFT JOIN c_velocity v ON v.ent = g.ent AND v.grp = p.velocity_tier""")
def _(spark, sf):
    rows = li(spark, sf)
    return J.similar_group_cutoff(games(rows), pair_days(spark, sf), profile(rows), "ent", "opp", "day", "1999-12-31")


WEATHER = """wx AS (SELECT day AS date, CASE WHEN park < 20 THEN park ELSE park + 100 END AS stadium, avg(x) + 40 AS temperature, avg(speed) / 3 AS wind_speed,
  CAST(sum(l_orderkey) % 360 AS DOUBLE) AS wind_direction, avg(inning) * 10 AS humidity, 29 + avg(hit) AS pressure
  FROM li GROUP BY 1, 2)"""
GAME_DAYS = "gd AS (SELECT ent, park AS stadium, day AS date, sum(hit) AS hr FROM li GROUP BY 1, 2, 3)"
WX = "coalesce(temperature, 72) AS temperature, coalesce(wind_speed, 5) AS wind_speed, coalesce(wind_direction, 0) AS " \
     "wind_direction, coalesce(humidity, 50) AS humidity, coalesce(pressure, 29.92) AS pressure"
WX_SPEC = "temperature:f wind_speed:f wind_direction:f humidity:f pressure:f"


def weather(rows):
    return rows.groupBy(F.col("day").alias("date"), F.expr("CASE WHEN park < 20 THEN park ELSE park + 100 END").alias("stadium")).agg(
        (F.avg("x") + 40).alias("temperature"), (F.avg("speed") / 3).alias("wind_speed"),
        (F.sum("l_orderkey") % 360).cast("double").alias("wind_direction"), (F.avg("inning") * 10).alias("humidity"),
        (29 + F.avg("hit")).alias("pressure"))


def game_days(rows):
    return rows.groupBy("ent", F.col("park").alias("stadium"), F.col("day").alias("date")).agg(F.sum("hit").alias("hr"))


@query("j9_join_weather", "ent:l stadium:l date:d hr:l " + WX_SPEC, f"""
WITH {LI}, {WEATHER}, {GAME_DAYS} SELECT ent, stadium, date, hr, {WX} FROM gd LEFT JOIN wx USING (date, stadium)""")
def _(spark, sf):
    rows = li(spark, sf)
    return J.join_weather(game_days(rows), weather(rows))


@query("j9_accept_feed", "stadium:l date:d temperature:f", f"""
WITH {LI}, {WEATHER} SELECT stadium, date, temperature FROM wx
WHERE (SELECT avg(CASE WHEN temperature IS NOT NULL AND humidity IS NOT NULL THEN 1 ELSE 0 END) FROM wx) > 0.5""")
def _(spark, sf):
    feed = weather(li(spark, sf))
    holes = feed.withColumn("humidity", F.lit(None).cast("double"))
    return J.accept_feed(holes, feed)


ODDS = """od AS (SELECT date, CASE WHEN offer % 3 <> 0 THEN 'Player ' ELSE 'Other ' END || player AS batter_name, max(odds_yes) AS odds_hr_yes, max(bookmaker) AS bookmaker
  FROM board GROUP BY 1, 2), pr AS (SELECT offer, date, 'Player ' || player AS batter_name, p FROM board)"""


def odds_sides(spark, sf):
    board = odds_board(spark, sf)
    odds = board.groupBy(
        "date", F.concat(F.lit(" "), "player", F.expr("CASE WHEN offer % 3 <> 0 THEN ', Player ' ELSE ', Other ' END")).alias("batter_name")).agg(
        F.max("odds_yes").alias("odds_hr_yes"), F.max("bookmaker").alias("bookmaker"))
    return board.select("offer", "date", F.concat(F.lit("Player "), "player").alias("batter_name"), "p"), odds


@query("j10_join_odds", "offer:l date:d batter_name:s p:f odds_hr_yes:f bookmaker:s", f"""
WITH {BOARD}, {ODDS} SELECT offer, date, batter_name, p, odds_hr_yes, coalesce(bookmaker, 'No Odds Available') AS bookmaker
FROM pr LEFT JOIN od USING (date, batter_name)""")
def _(spark, sf):
    predictions, odds = odds_sides(spark, sf)
    return J.join_odds(predictions, odds, "date", "batter_name", ["odds_hr_yes"], "bookmaker")


@query("j11_join_odds_by_name", "user_id:l day:d name:s odds_hr_yes:f", f"""
WITH {EV_DAY}, {BOARD}, o AS (SELECT 'Player ' || player AS name, max(odds_yes) AS odds_hr_yes FROM board GROUP BY 1)
SELECT user_id, day, name, odds_hr_yes FROM (SELECT user_id, day, 'Player ' || (user_id + 1400) AS name FROM d)
LEFT JOIN o USING (name)""")
def _(spark, sf):
    rows = ev_day(spark, sf).select("user_id", "day", F.concat(F.lit("Player "), F.col("user_id") + 1400).alias("name"))
    odds = odds_board(spark, sf).groupBy(F.concat(F.col("player"), F.lit(", Player")).alias("name")).agg(
        F.max("odds_yes").alias("odds_hr_yes"))
    return J.join_odds_by_name(rows, odds, "name", ["odds_hr_yes"])


@query("j12_match_names_contains", "target:s name:s", """
WITH t AS (SELECT DISTINCT upper(p_name) || CASE WHEN p_size < 10 THEN '' ELSE ' OTHER' END AS target FROM part WHERE p_name IS NOT NULL
  UNION SELECT DISTINCT p_type FROM part), n AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS name FROM part)
SELECT target, name FROM n JOIN t ON contains(lower(name), lower(target))""")
def _(spark, sf):
    parts = table(spark, sf, "part")
    targets = parts.select(F.concat(F.upper("p_name"), F.when(F.col("p_size") < 10, "").otherwise(" OTHER")).alias("target")).union(parts.select("p_type"))
    names = parts.select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    return J.match_names_contains(names, "name", targets, "target")


@query("j12_template_rows", "target:s last_orderkey:l recent_price:f recent_rows:l", """
WITH m AS (SELECT CASE WHEN c_acctbal > 9000 THEN 'MEMBER ' ELSE 'OTHER ' END || c_custkey || '#' AS target, CASE WHEN c_acctbal > 9000 THEN c_custkey END AS k FROM customer),
r AS (SELECT target, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY target ORDER BY o_orderdate DESC, o_orderkey DESC)
  AS rk FROM orders JOIN m ON o_custkey = k)
SELECT target, max(CASE WHEN rk = 1 THEN o_orderkey END) AS last_orderkey, avg(o_totalprice) AS recent_price,
  count(*) AS recent_rows FROM r WHERE rk <= 10 GROUP BY 1""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("Mr Member "), "o_custkey", F.lit("# x")).alias("name"), "o_orderdate",
        F.col("o_orderkey").alias("last_orderkey"), F.col("o_totalprice").alias("price"))
    targets = table(spark, sf, "customer").select(
        F.concat(F.when(F.col("c_acctbal") > 9000, "MEMBER ").otherwise("OTHER "), "c_custkey", F.lit("#")).alias("target"))
    matches = J.match_names_contains(orders, "name", targets, "target")
    return J.template_rows(orders, matches, "name", [F.desc("o_orderdate"), F.desc("last_orderkey")],
                           ["last_orderkey"], ["price"])


@query("j13_latest_row_match", "player:l offer:l rank:i odds_hr_yes:f", f"""
WITH {BOARD}, r AS (SELECT player, offer, row_number() OVER (PARTITION BY player ORDER BY date DESC, offer DESC) AS rank FROM board),
o AS (SELECT player, max(odds_yes) AS odds_hr_yes FROM board GROUP BY 1)
SELECT r.player, offer, rank, CASE WHEN rank = 1 THEN odds_hr_yes END AS odds_hr_yes FROM r JOIN o USING (player) WHERE rank <= 7""")
def _(spark, sf):
    board = odds_board(spark, sf)
    odds = board.groupBy("player").agg(F.max("odds_yes").alias("odds_hr_yes"))
    return J.latest_row_match(board.select("player", "offer", "date"), odds, "player",
                              [F.desc("date"), F.desc("offer")], ["odds_hr_yes"])


@query("j14_rebuild_recent_report", "game_id:l game_date:d player_name:s hits:l pitcher:l temperature:f", """
SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, p.player_name, p.hits, s.pitcher, w.temperature
FROM orders LEFT JOIN (SELECT CASE WHEN l_linestatus = 'F' THEN l_orderkey ELSE -l_orderkey END AS l_orderkey, 'part ' || l_partkey AS player_name, count(*) AS hits FROM lineitem
  GROUP BY 1, 2) p ON p.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS pitcher, max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS is_starter
  FROM lineitem GROUP BY 1) s ON s.l_orderkey = o_orderkey AND s.is_starter = 1
LEFT JOIN (SELECT CASE WHEN l_returnflag = 'A' THEN l_orderkey ELSE -l_orderkey END AS l_orderkey, avg(l_quantity) AS temperature FROM lineitem GROUP BY 1) w
  ON w.l_orderkey = o_orderkey
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND p.player_name IS NOT NULL""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("game_id", F.col("l_orderkey"))
    games_ = table(spark, sf, "orders").select(F.col("o_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("game_date"))
    performances = lines.groupBy(
        F.expr("CASE WHEN l_linestatus = 'F' THEN game_id ELSE -game_id END").alias("game_id"), F.concat(F.lit("part "), "l_partkey").alias("player_name")).agg(F.count(F.lit(1)).alias("hits"))
    starters = lines.groupBy("game_id").agg(
        F.min("l_suppkey").alias("pitcher"), F.max((F.col("l_linenumber") == 1).cast("int")).alias("is_starter"))
    climate = lines.groupBy(F.expr("CASE WHEN l_returnflag = 'A' THEN game_id ELSE -game_id END").alias("game_id")).agg(F.avg("l_quantity").alias("temperature"))
    return J.rebuild_recent_report(games_, performances, starters, climate, "game_date", "1997-01-01", "1999-12-31")


@query("j15_lookup_matchup_features", "ent:l opp:l pa:l handedness:s velocity_tier:s vs_hand_pa:l vs_hand_hr_rate:f "
       "vs_velocity_pa:l vs_velocity_hr_rate:f", f"""
WITH {LI}, {PROFILE}, {SIMILAR}, m AS (SELECT ent, opp, sum(att) AS pa FROM li GROUP BY 1, 2),
q AS (SELECT DISTINCT ent, cust % 30 AS opp FROM li)
SELECT q.ent, q.opp, m.pa, handedness, velocity_tier, h.pa AS vs_hand_pa, h.hr / h.pa AS vs_hand_hr_rate,
  v.pa AS vs_velocity_pa, v.hr / v.pa AS vs_velocity_hr_rate
FROM q LEFT JOIN m ON m.ent = q.ent AND m.opp = q.opp LEFT JOIN prof ON prof.opp = q.opp
LEFT JOIN sim h ON h.ent = q.ent AND h.group_type = 'handedness' AND h.group_value = handedness
LEFT JOIN sim v ON v.ent = q.ent AND v.group_type = 'velocity' AND v.group_value = velocity_tier""")
def _(spark, sf):
    rows = li(spark, sf)
    batch = rows.select("ent", (F.col("cust") % 30).alias("opp")).distinct()
    stored = rows.groupBy("ent", "opp").agg(F.sum("att").alias("pa"))
    shapes = profile(rows)
    return J.lookup_matchup_features(batch, stored, shapes, A.similarity_stats(rows, shapes, "ent", "opp", "att", "hit"), "ent", "opp")


@query("j16_join_pitch_slg", "ent:l day:d n:l slg_A:f slg_R:f", f"""
WITH {LI}, s AS (SELECT ent, day, avg(hit) FILTER (hand = 'A' AND att = 1) AS slg_A,
  avg(hit) FILTER (hand = 'R' AND att = 1) AS slg_R FROM li GROUP BY 1, 2),
g AS (SELECT ent, day, count(*) AS n FROM li GROUP BY 1, 2) SELECT g.*, slg_A, slg_R FROM g LEFT JOIN s USING (ent, day)""")
def _(spark, sf):
    # the joined lines are read twice, so they are written once; both sides are dealt out alike by (ent, day)
    parts = parts_of(table(spark, sf, "lineitem"))
    rows = dealt_out(materialise(li(spark, sf, parts).select("ent", "day", "hand", "att", "hit")), parts, "ent", "day")
    slg = rows.groupBy("ent", "day").agg(
        *[F.avg(F.when((F.col("hand") == k) & (F.col("att") == 1), F.col("hit"))).alias(f"slg_{k}") for k in ("A", "R")])
    return J.join_pitch_slg(rows.groupBy("ent", "day").agg(F.count(F.lit(1)).alias("n")), slg, "ent", "day")
