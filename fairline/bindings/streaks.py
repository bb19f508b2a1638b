"""W17-W35 on events: a game is one half-day of a user, a hit is any purchase in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.bindings.frames import EV, ev
from fairline.bindings.registry import query
from fairline.operators import streak as S

GAMES = EV + """, gm AS (SELECT user_id, day, CASE WHEN hr < 12 THEN 0 ELSE 1 END AS half, max(hit) AS hit,
  CASE WHEN avg(angle) > 50 THEN 1 ELSE 0 END AS lev, CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS clu FROM ev GROUP BY 1, 2, 3),
dy AS (SELECT user_id, day, CAST(datediff('day', DATE '1970-01-01', day) AS INTEGER) AS dn, avg(hit) AS rate, count(*) AS n FROM gm GROUP BY 1, 2),
p AS (SELECT k.user_id, k.day, k.dn AS cdn, d.dn, d.rate, d.n, row_number() OVER (PARTITION BY k.user_id, k.day ORDER BY d.dn) AS i,
  row_number() OVER (PARTITION BY k.user_id, k.day ORDER BY d.dn DESC) AS j FROM dy k JOIN dy d ON d.user_id = k.user_id
  AND d.dn BETWEEN k.dn - 21 AND k.dn - 1),
gp AS (SELECT k.user_id, k.day, CAST(datediff('day', DATE '1970-01-01', g.day) AS INTEGER) AS dn, g.half, g.hit, g.lev, g.clu,
  row_number() OVER (PARTITION BY k.user_id, k.day ORDER BY g.day DESC, g.half DESC) AS j FROM dy k JOIN gm g ON g.user_id = k.user_id
  AND g.day < k.day AND g.day >= k.day - 21),
c AS (SELECT dy.user_id, dy.day, dy.dn, coalesce(sum(p.n), 0) AS g21, coalesce(sum(p.n) FILTER (p.dn >= cdn - 7), 0) AS g7,
  coalesce(sum(p.n) FILTER (p.dn >= cdn - 5), 0) AS g5, count(p.dn) AS m21, count(*) FILTER (p.dn >= cdn - 7) AS m7,
  count(*) FILTER (p.dn >= cdn - 5) AS m5, max(p.dn) AS mx, min(p.dn) AS mn FROM dy LEFT JOIN p ON p.user_id = dy.user_id AND p.day = dy.day
  GROUP BY 1, 2, 3)"""


def _islands(name: str, condition: str) -> str:
    return f"""{name}_r AS (SELECT user_id, day, i - k AS grp, count(*) AS len, max(dn) AS last, min(j) AS j1 FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id, day ORDER BY dn) AS k FROM p WHERE {condition}) GROUP BY 1, 2, 3),
{name} AS (SELECT user_id, day, max(len) AS best, max(len) FILTER (j1 = 1) AS cur, max(last) FILTER (len >= 3) AS last,
  count(*) FILTER (len >= 3) AS runs FROM {name}_r GROUP BY 1, 2)"""


RUNS = f"{_islands('hot', 'rate >= 0.15')}, {_islands('cold', 'rate <= 0.05')}"
# Slope, curvature and weighted sums of the last rows of each look-back.
MOM = """i7 AS (SELECT user_id, day, rate, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, day) AS m, j
  FROM p WHERE dn >= cdn - 7 WINDOW w AS (PARTITION BY user_id, day ORDER BY dn)),
m7 AS (SELECT user_id, day, regr_slope(rate, i) AS s, var_samp(rate) AS v, avg(rate) AS mu, avg(rate) FILTER (j <= 3) AS mu3,
  sum(rate * exp(-(j - 1) / 3.0)) / sum(exp(-(j - 1) / 3.0)) AS pm, 2 * sum(rate * ((i - (m + 1) / 2.0) ** 2 - (m * m - 1) / 12.0)) /
  nullif(sum(((i - (m + 1) / 2.0) ** 2 - (m * m - 1) / 12.0) ** 2), 0) AS q FROM i7 GROUP BY 1, 2)"""
VEL = """v1 AS (SELECT user_id, day, dn, rate, j, rate - lag(rate) OVER w AS d1 FROM p WHERE dn >= cdn - 5 WINDOW w AS (PARTITION BY user_id, day ORDER BY dn)),
v2 AS (SELECT *, d1 - lag(d1) OVER w AS d2 FROM v1 WINDOW w AS (PARTITION BY user_id, day ORDER BY dn)),
m5 AS (SELECT user_id, day, avg(d1) FILTER (j <= 3) AS vel, avg(d2) FILTER (j <= 2) AS acc, var_samp(d1) AS vv,
  max(rate) FILTER (j = 1) AS r3, max(rate) FILTER (j = 3) AS r1 FROM v2 GROUP BY 1, 2)"""
LAST5 = """l5 AS (SELECT user_id, day, regr_slope(rate, i) FILTER (j <= 5) AS s, count(*) FILTER (j <= 5) AS m, max(rate) FILTER (j = 1) AS r0,
  avg(CASE WHEN rate < 0.05 THEN 1 ELSE 0 END) FILTER (j <= 5) AS low, avg(rate) AS mu, stddev_samp(rate) AS sd,
  avg(rate) FILTER (j <= 3) AS ma3, avg(rate) FILTER (j <= 7) AS ma7, sum(exp((dn - mx) / 7.0) * greatest(0, rate - 0.15)) / sum(exp((dn - mx) / 7.0)) AS hi,
  sum(exp((dn - mx) / 7.0) * greatest(0, 0.05 - rate)) / sum(exp((dn - mx) / 7.0)) AS lo
  FROM (SELECT *, max(dn) OVER (PARTITION BY user_id, day) AS mx FROM p) GROUP BY 1, 2),
f3 AS (SELECT user_id, day, min(rate) FILTER (j > m - 3) AS low3 FROM (SELECT *, max(j) OVER (PARTITION BY user_id, day) AS m FROM p WHERE j <= 5) GROUP BY 1, 2)"""
GAME_STATS = """hg AS (SELECT user_id, day, dn - lag(dn) OVER (PARTITION BY user_id, day ORDER BY dn, half) AS gap FROM gp WHERE hit = 1),
rh AS (SELECT user_id, day, var_samp(gap) AS v, count(*) AS k FROM hg GROUP BY 1, 2),
cf AS (SELECT user_id, day, avg(hit) AS mu, avg(hit) FILTER (j <= 5) AS r5, var_samp(hit) FILTER (j <= 5) AS v5, count(*) AS k,
  avg(hit) FILTER (lev = 1) AS hl, avg(hit) FILTER (lev = 0) AS hn FROM gp GROUP BY 1, 2),
tg AS (SELECT user_id, day, hit, lag(hit) OVER w AS h1, lag(hit, 2) OVER w AS h2 FROM gp WINDOW w AS (PARTITION BY user_id, day ORDER BY dn, half)),
mt AS (SELECT user_id, day, count(*) FILTER (h1 = 0 AND h2 = 0) AS k, count(*) FILTER (h1 = 0 AND h2 = 0 AND hit = 1) AS b FROM tg GROUP BY 1, 2),
ck AS (SELECT user_id, day, dn, avg(hit) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY dn DESC, half DESC) AS k
  FROM gp WHERE clu = 1) WHERE k <= 5 GROUP BY 1, 2, 3),
cm AS (SELECT user_id, day, CASE WHEN count(*) > 1 THEN regr_slope(rate, i) END AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY dn) AS i FROM ck) GROUP BY 1, 2)"""
PARTS = f"WITH {GAMES}, {RUNS}, {MOM}, {VEL}, {LAST5}, {GAME_STATS}"
JOINS = " ".join(f"LEFT JOIN {t} ON {t}.user_id = c.user_id AND {t}.day = c.day"
                 for t in ("hot", "cold", "m7", "m5", "l5", "f3", "rh", "cf", "mt", "cm"))

SQL = {
    "current_hot_streak": "CASE WHEN g21 >= 3 THEN coalesce(hot.cur, 0) ELSE 0 END",
    "current_cold_streak": "CASE WHEN g21 >= 3 THEN coalesce(cold.cur, 0) ELSE 0 END",
    "max_hot_streak_21d": "CASE WHEN g21 >= 3 THEN coalesce(hot.best, 0) ELSE 0 END",
    "max_cold_streak_21d": "CASE WHEN g21 >= 3 THEN coalesce(cold.best, 0) ELSE 0 END",
    "hot_streak_intensity": "CASE WHEN g21 >= 3 THEN l5.hi ELSE 0 END",
    "cold_streak_depth": "CASE WHEN g21 >= 3 THEN l5.lo ELSE 0 END",
    "days_since_hot_streak": "CASE WHEN g21 >= 3 THEN c.dn - hot.last END",
    "days_since_cold_streak": "CASE WHEN g21 >= 3 THEN c.dn - cold.last END",
    "hot_streak_frequency": "CASE WHEN g21 >= 3 THEN coalesce(hot.runs, 0) / greatest((mx - mn + 1) / 7.0, 1) ELSE 0 END",
    "cold_streak_frequency": "CASE WHEN g21 >= 3 THEN coalesce(cold.runs, 0) / greatest((mx - mn + 1) / 7.0, 1) ELSE 0 END",
    "recovery_momentum": "CASE WHEN g21 >= 3 AND l5.m >= 3 THEN l5.s * (1 + 2 * greatest(0, 0.15 - low3)) ELSE 0 END",
    "slump_risk_indicator": "CASE WHEN g21 >= 3 AND l5.m >= 3 THEN least(1, CASE WHEN l5.s < 0 THEN -2 * l5.s ELSE 0 END + "
                            "greatest(0, 3 * (0.05 - r0)) + 0.5 * low) ELSE 0 END",
    "power_momentum_7d": "CASE WHEN g7 >= 3 THEN pm ELSE 0 END",
    "consistency_momentum": "CASE WHEN g7 >= 3 THEN 1 / (1 + 10 * m7.v) ELSE 0 END",
    "momentum_sustainability": "CASE WHEN g7 < 3 THEN 0 WHEN m7.v IS NOT NULL THEN least(1, 1 / (1 + 5 * m7.v) * least(m7 / 10.0, 1) * "
                               "least(mu3 / greatest(m7.mu, 0.01), 2) / 2) END".replace("least(m7 /", "least(c.m7 /"),
    "trend_acceleration": "CASE WHEN g7 >= 4 AND c.m7 >= 4 THEN q ELSE 0 END",
    "momentum_direction": "CASE WHEN g7 < 3 OR m7.s IS NULL OR abs(m7.s) < 0.001 THEN 0 WHEN m7.s > 0 THEN 1 ELSE -1 END",
    "momentum_strength": "CASE WHEN g7 >= 3 THEN coalesce(abs(m7.s), 0) ELSE 0 END",
    "hr_rate_velocity": "CASE WHEN g5 >= 2 AND c.m5 >= 2 THEN vel ELSE 0 END",
    "performance_acceleration": "CASE WHEN g5 >= 3 AND c.m5 >= 3 THEN acc ELSE 0 END",
    "velocity_consistency": "CASE WHEN g5 >= 3 AND c.m5 >= 3 THEN 1 / (1 + 20 * vv) ELSE 0 END",
    "breakout_velocity": "CASE WHEN g5 >= 3 AND c.m5 >= 3 THEN greatest(0, (r3 - r1) * (1 + greatest(0, 0.15 - r1))) ELSE 0 END",
    "hot_cold_cycle_position": "CASE WHEN g21 < 5 OR m21 < 7 THEN 0 WHEN ma3 - ma7 > 0.05 THEN 1 WHEN ma3 - ma7 < -0.05 THEN -1 ELSE 0 END",
    "cycle_prediction": "CASE WHEN g21 >= 7 AND l5.m >= 3 THEN r0 + l5.s ELSE 0 END",
    "pattern_stability": "CASE WHEN g21 >= 5 AND m21 >= 5 AND l5.mu <> 0 THEN 1 / (1 + sd / l5.mu) ELSE 0 END",
    "rhythm_indicator": "CASE WHEN g21 >= 5 AND rh.k >= 3 THEN 1 / (1 + rh.v / 5) ELSE 0 END",
    "confidence_indicator": "CASE WHEN g21 >= 3 THEN least(2, cf.r5 / greatest(cf.mu, 0.01) / (1 + 5 * v5)) ELSE 0 END",
    "mental_toughness": "CASE WHEN g21 >= 5 AND mt.k > 0 THEN b / CAST(mt.k AS DOUBLE) ELSE 0 END",
    "pressure_response": "CASE WHEN g21 >= 3 AND hl IS NOT NULL AND hn IS NOT NULL THEN hl / greatest(hn, 0.01) ELSE 0 END",
    "clutch_momentum": "CASE WHEN g21 >= 3 THEN coalesce(cm.s, 0) ELSE 0 END",
}


def game_rows(spark, sf):
    return ev(spark, sf).groupBy("user_id", "day", F.when(F.col("hr") < 12, 0).otherwise(1).alias("half")).agg(
        F.max("hit").alias("hit"), (F.avg("angle") > 50).cast("int").alias("lev"), (F.count(F.lit(1)) > 1).cast("int").alias("clu"))


def _register(name: str, columns: list[str]) -> None:
    spec = "user_id:l day:d " + " ".join(f"{c}:f" for c in columns)
    sql = f"{PARTS} SELECT c.user_id, c.day, {', '.join(f'{SQL[c]} AS {c}' for c in columns)} FROM c {JOINS}"

    @query(name, spec, sql)
    def _(spark, sf):
        return S.streak_feature_set(game_rows(spark, sf), "user_id", "day", "half", "hit", "lev", "clu")


_register("w17_current_streak", ["current_hot_streak", "current_cold_streak"])
_register("w18_max_streak", ["max_hot_streak_21d", "max_cold_streak_21d"])
_register("w19_streak_intensity_depth", ["hot_streak_intensity", "cold_streak_depth"])
_register("w20_days_since_streak", ["days_since_hot_streak", "days_since_cold_streak"])
_register("w21_streak_frequency", ["hot_streak_frequency", "cold_streak_frequency"])
_register("w22_recovery_momentum", ["recovery_momentum"])
_register("w23_slump_risk", ["slump_risk_indicator"])
_register("w24_power_momentum", ["power_momentum_7d"])
_register("w25_consistency_sustainability", ["consistency_momentum", "momentum_sustainability"])
_register("w26_trend_acceleration", ["trend_acceleration"])
_register("w27_momentum_vector", ["momentum_direction", "momentum_strength"])
_register("w28_rate_velocity_acceleration", ["hr_rate_velocity", "performance_acceleration"])
_register("w29_velocity_consistency_breakout", ["velocity_consistency", "breakout_velocity"])
_register("w30_cycle_position_prediction", ["hot_cold_cycle_position", "cycle_prediction"])
_register("w31_pattern_stability_rhythm", ["pattern_stability", "rhythm_indicator"])
_register("w32_confidence_indicator", ["confidence_indicator"])
_register("w33_mental_toughness", ["mental_toughness"])
_register("w34_pressure_clutch", ["pressure_response", "clutch_momentum"])
_register("w35_streak_feature_set", list(SQL))
