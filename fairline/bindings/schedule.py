"""W36-W40 on events: a game is one half-day of a user; the place follows from user and day."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.bindings.frames import EV, ev
from fairline.bindings.registry import query, table
from fairline.operators import schedule as H

GAMES = EV + """, g AS (SELECT user_id, day, CASE WHEN hr < 14 THEN 0 ELSE 1 END AS half, count(*) AS n,
  CAST(datediff('day', DATE '1970-01-01', day) AS INTEGER) AS dn FROM ev GROUP BY 1, 2, 3),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dn, half) AS r, (user_id * 7 + dn // 2) % 25 AS place,
  (user_id + dn // 3) % 2 AS home FROM g)"""
KEYS = "user_id:l day:d half:i "


def game_rows(spark, sf):
    rows = ev(spark, sf).groupBy(
        "user_id", "day", F.when(F.col("hr") < 14, 0).otherwise(1).alias("half")).agg(F.count(F.lit(1)).alias("n"))
    return H.numbered(rows, "day").withColumns({
        "place": (F.col("user_id") * 7 + F.floor(F.col("dn") / 2)) % 25, "home": (F.col("user_id") + F.floor(F.col("dn") / 3)) % 2})


@query("w36_fatigue_state", KEYS + "games_without_rest:l cumulative_fatigue:f fatigue_level:f energy_reserves:f recovery_status:f", f"""
WITH RECURSIVE {GAMES}, x AS (SELECT user_id, day, half, r, dn, 0 AS streak, CAST(0 AS DOUBLE) AS load FROM q WHERE r = 1
  UNION ALL SELECT q.user_id, q.day, q.half, q.r, q.dn, CASE WHEN q.dn - x.dn <= 1 THEN x.streak + 1 ELSE 0 END,
  CAST(CASE WHEN q.dn = x.dn THEN x.load + 0.03 WHEN q.dn - x.dn = 1 THEN x.load + 0.02
  ELSE greatest(0, x.load - 0.05 * (q.dn - x.dn - 1)) END AS DOUBLE) FROM x JOIN q ON q.user_id = x.user_id AND q.r = x.r + 1)
SELECT user_id, day, half, streak AS games_without_rest, load AS cumulative_fatigue, least(1, load / 0.2) AS fatigue_level,
  greatest(0.3, 1 - least(1, load / 0.2)) AS energy_reserves, greatest(0.5, 1 - load) AS recovery_status FROM x""")
def _(spark, sf):
    return H.fatigue_state(game_rows(spark, sf), "user_id", "half")


@query("w37_rest_deficit", KEYS + "rest_deficit:f", f"""
WITH {GAMES} SELECT user_id, day, half, CASE WHEN count(*) OVER w > 1 THEN greatest(0, 0.15 - greatest(0,
  (max(dn) OVER w - min(dn) OVER w + 1 - count(*) OVER w) / (max(dn) OVER w - min(dn) OVER w + 1))) ELSE 0 END AS rest_deficit
FROM q WINDOW w AS (PARTITION BY user_id ORDER BY r ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return H.rest_deficit(game_rows(spark, sf), "user_id", "half")


@query("w38_travel_features", KEYS + "timezone_change:l jet_lag_factor:f travel_fatigue:f cross_country_travel:i "
       "home_away_transition:i time_zone_adjustment:f", f"""
WITH {GAMES}, z AS (SELECT q.*, coalesce(off, -5) AS tz FROM q LEFT JOIN (SELECT n_nationkey, -5 - n_nationkey % 4 AS off FROM nation
  WHERE n_nationkey < 20) ON place = n_nationkey), y AS (SELECT b.*, b.dn - a.dn AS gap, b.place <> a.place AND b.dn - a.dn <= 3 AS moved,
  b.tz - a.tz AS s, b.home <> a.home AS flip FROM z b LEFT JOIN z a ON a.user_id = b.user_id AND a.r = b.r - 1),
t AS (SELECT *, CASE WHEN moved AND abs(s) >= 2 THEN abs(s) / 3.0 * 0.05 * CASE WHEN s > 0 THEN 1.5 ELSE 1 END ELSE 0 END AS jl FROM y)
SELECT b.user_id, b.day, b.half, CASE WHEN b.moved THEN abs(b.s) ELSE 0 END AS timezone_change, b.jl AS jet_lag_factor,
  CASE WHEN b.jl > 0 THEN least(0.1, 0.02 * abs(b.s)) ELSE 0 END AS travel_fatigue, CASE WHEN b.jl > 0 AND abs(b.s) >= 3 THEN 1 ELSE 0 END AS cross_country_travel,
  CASE WHEN b.moved AND b.flip THEN 1 ELSE 0 END AS home_away_transition, CASE WHEN a.jl > 0 AND b.gap >= 1 THEN a.jl * (1 - 0.5 * least(b.gap, 3)) ELSE 0 END AS time_zone_adjustment
FROM t b LEFT JOIN t a ON a.user_id = b.user_id AND a.r = b.r - 1""")
def _(spark, sf):
    offsets = table(spark, sf, "nation").select(
        F.expr("CASE WHEN n_nationkey < 20 THEN n_nationkey ELSE n_nationkey + 100 END").alias("place"), (-5 - F.col("n_nationkey") % 4).alias("utc_offset"))
    return H.travel_features(game_rows(spark, sf), "user_id", "half", "place", offsets, home="home")


@query("w39_rest_patterns", KEYS + "days_since_rest:l rest_quality_score:f consecutive_games:l weekly_game_density:f rest_vs_schedule:f "
       "recovery_time_available:f", f"""
WITH {GAMES}, n AS (SELECT *, lead(dn) OVER (PARTITION BY user_id ORDER BY r) AS nxt FROM q),
c AS (SELECT b.user_id, b.r, b.r - coalesce(max(a.r), 0) AS consecutive_games FROM n b LEFT JOIN n a ON a.user_id = b.user_id AND a.r < b.r
  AND a.nxt - a.dn > b.r - a.r GROUP BY 1, 2), s AS (SELECT b.user_id, b.r, coalesce(b.dn - max(a.dn) FILTER (a.dn <= b.dn - 2) - 1, b.r - 1) AS since,
  count(a.dn) FILTER (a.dn >= b.dn - 7) / 7.0 AS dens FROM n b LEFT JOIN n a ON a.user_id = b.user_id AND a.dn <= b.dn GROUP BY b.user_id, b.r, b.dn)
SELECT n.user_id, n.day, n.half, since AS days_since_rest, greatest(0.5, 1 - 0.05 * since) AS rest_quality_score, consecutive_games,
  dens AS weekly_game_density, 4.5 / 7 - dens AS rest_vs_schedule, least(3, coalesce(nxt - dn, 1)) AS recovery_time_available
FROM n JOIN c USING (user_id, r) JOIN s USING (user_id, r)""")
def _(spark, sf):
    return H.rest_patterns(game_rows(spark, sf), "user_id", "half")


@query("w40_schedule_density", KEYS + "games_last_7_days:l games_last_14_days:l games_next_7_days:l schedule_intensity:f upcoming_workload:f recent_workload:f", f"""
WITH {GAMES}, t AS (SELECT user_id, day, half, count(*) OVER (PARTITION BY user_id ORDER BY dn RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS a,
  count(*) OVER (PARTITION BY user_id ORDER BY dn RANGE BETWEEN 14 PRECEDING AND CURRENT ROW) AS b,
  count(*) OVER (PARTITION BY user_id ORDER BY dn RANGE BETWEEN CURRENT ROW AND 7 FOLLOWING) AS c FROM q)
SELECT user_id, day, half, a AS games_last_7_days, b AS games_last_14_days, c AS games_next_7_days, (a + c) / 14.0 AS schedule_intensity,
  c / 7.0 AS upcoming_workload, a / 7.0 AS recent_workload FROM t""")
def _(spark, sf):
    return H.schedule_density(game_rows(spark, sf), "user_id")
