"""W1-W10 on events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.bindings.aggregates import PAIR_DAY, pair_days
from fairline.bindings.frames import EV_DAY, LI, ev_day, li
from fairline.bindings.joins import GAMES, games
from fairline.bindings.registry import query
from fairline.operators import aggregate as A
from fairline.operators import rolling as R

ROWS10 = "PARTITION BY {k} ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING"
DAYS30 = "PARTITION BY {k} ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW"


def windows_sql(source: str, keys: str, sums: list[str], means: list[str], a: str = "roll10_", b: str = "roll30d_") -> str:
    """Rows ``w`` with the 10-row lagged and the lagged 30-day columns."""
    items = [("sum", c) for c in sums] + [("avg", c) for c in means]
    one = ", ".join(f"{f}({c}) OVER ({ROWS10.format(k=keys)}) AS {a}{c}" for f, c in items)
    two = ", ".join(f"{f}({c}) OVER ({DAYS30.format(k=keys)}) AS t_{c}" for f, c in items)
    lag = ", ".join(f"lag(t_{c}) OVER (PARTITION BY {keys} ORDER BY day) AS {b}{c}" for _, c in items)
    return f"wi AS (SELECT *, {one}, {two} FROM {source}), w AS (SELECT *, {lag} FROM wi)"


def lagged(daily, keys, sums, means):
    return R.rolling_days_lagged(R.rolling_rows_lagged(daily, keys, ["dn"], sums, means), keys, "dn", sums, means)


@query("w1_rolling_rows_lagged", "user_id:l day:d roll10_att:l roll10_hit:l roll10_x:f roll10_angle:f lag3_hit:l", f"""
WITH {EV_DAY} SELECT user_id, day, sum(att) OVER w AS roll10_att, sum(hit) OVER w AS roll10_hit, avg(x) OVER w AS roll10_x,
  avg(angle) OVER w AS roll10_angle, sum(hit) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 3 PRECEDING)
  AS lag3_hit FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    one = R.rolling_rows_lagged(ev_day(spark, sf), ["user_id"], ["dn"], ["att", "hit"], ["x", "angle"])
    return R.rolling_rows_lagged(one, ["user_id"], ["dn"], ["hit"], [], n=5, lag=3, prefix="lag3_")


@query("w2_rolling_days_lagged", "ent:l day:d roll30d_pa:l roll30d_x:f", f"""
WITH {LI}, e AS (SELECT ent, day, sum(att) AS pa, avg(x) AS x FROM li GROUP BY 1, 2), t AS (SELECT ent, day,
  sum(pa) OVER w AS pa, avg(x) OVER w AS x FROM e WINDOW w AS ({DAYS30.format(k='ent')}))
SELECT ent, day, lag(pa) OVER v AS roll30d_pa, lag(x) OVER v AS roll30d_x FROM t WINDOW v AS (PARTITION BY ent ORDER BY day)""")
def _(spark, sf):
    daily = A.entity_game_agg(li(spark, sf), ["ent", "day"], {"pa": "att"}, {"x": "x"}).withColumn("dn", F.unix_date("day"))
    return R.rolling_days_lagged(daily, ["ent"], "dn", ["pa"], ["x"])


@query("w3_rate_and_flags", "user_id:l day:d roll10_rate:f roll30d_rate:f prior_high_ev:i prior_opt_la:i", f"""
WITH {EV_DAY}, {windows_sql('d', 'user_id', ['att', 'hit'], ['x', 'angle'])}
SELECT user_id, day, roll10_hit / (roll10_att + 0.000001) AS roll10_rate, roll30d_hit / (roll30d_att + 0.000001) AS roll30d_rate,
  CASE WHEN roll10_x > 90 THEN 1 ELSE 0 END AS prior_high_ev, CASE WHEN roll10_angle > 15 AND roll10_angle < 30 THEN 1 ELSE 0 END
  AS prior_opt_la FROM w""")
def _(spark, sf):
    w = lagged(ev_day(spark, sf), ["user_id"], ["att", "hit"], ["x", "angle"])
    return R.rate_and_flags(w, {"roll10_rate": ("roll10_hit", "roll10_att"), "roll30d_rate": ("roll30d_hit", "roll30d_att")},
                            "roll10_x", "roll10_angle")


@query("x0_top_lagged_rates", "user_id:l day:d roll10_rate:f roll30d_rate:f roll10_att:l", f"""
WITH {EV_DAY}, {windows_sql('d', 'user_id', ['att', 'hit'], [])}
SELECT user_id, day, roll10_hit / (roll10_att + 0.000001) AS roll10_rate, roll30d_hit / (roll30d_att + 0.000001) AS roll30d_rate,
  roll10_att FROM w WHERE roll10_att IS NOT NULL ORDER BY round(roll10_rate, 9) DESC, user_id, day LIMIT 50""")
def _(spark, sf):
    w = lagged(ev_day(spark, sf), ["user_id"], ["att", "hit"], [])
    rated = w.where(F.col("roll10_att").isNotNull()).withColumns({
        "roll10_rate": F.col("roll10_hit") / (F.col("roll10_att") + R.EPS),
        "roll30d_rate": F.col("roll30d_hit") / (F.col("roll30d_att") + R.EPS)})
    return rated.orderBy(F.desc(F.round("roll10_rate", 9)), "user_id", "day").limit(50)


_SPLIT_COLS = [f"{h}_{m}{t}" for h in ("A", "R") for m in ("pa", "hr", "x", "hr_rate") for t in ("10", "30d")]


@query("w4_split_rolling_pivot", "ent:l day:d " + " ".join(f"{c}:f" for c in _SPLIT_COLS), f"""
WITH {LI}, e AS (SELECT ent, hand, day, sum(att) AS pa, sum(hit) AS hr, avg(x) AS x FROM li GROUP BY 1, 2, 3),
{windows_sql('e', 'ent, hand', ['pa', 'hr'], ['x'], 'a_', 'b_')},
r AS (SELECT *, a_hr / (a_pa + 0.000001) AS a_hr_rate, b_hr / (b_pa + 0.000001) AS b_hr_rate FROM w)
SELECT ent, day, {', '.join(f"max({s}_{m}) FILTER (hand = '{h}') AS {h}_{m}{t}" for h in ('A', 'R')
                            for m in ('pa', 'hr', 'x', 'hr_rate') for s, t in (('a', '10'), ('b', '30d')))} FROM r GROUP BY 1, 2""")
def _(spark, sf):
    daily = A.split_day_agg(li(spark, sf), "ent", "hand", "day", {"pa": "att", "hr": "hit"}, {"x": "x"})
    return R.split_rolling_pivot(daily, "ent", "hand", ["A", "R"], "day", ["pa", "hr"], ["x"])


@query("w5_opponent_rolling", "opp:l day:d p_roll10_hr_allowed:l p_roll10_pa_faced:l p_roll10_ev_allowed:f p_roll10_vel:f "
       "p_roll30d_hr_allowed:l p_roll30d_ev_allowed:f p_roll10_hr_rate:f p_roll30d_hr_rate:f", f"""
WITH {LI}, e AS (SELECT opp, day, sum(hit) AS hr_allowed, sum(att) AS pa_faced, avg(x) AS ev_allowed, avg(speed) AS vel
  FROM li GROUP BY 1, 2), {windows_sql('e', 'opp', ['hr_allowed', 'pa_faced'], ['ev_allowed', 'vel'], 'p_roll10_', 'p_roll30d_')}
SELECT *, least(p_roll10_hr_allowed / (p_roll10_pa_faced + 0.000001), CASE WHEN p_roll10_pa_faced IS NULL THEN NULL ELSE 0.15 END) AS p_roll10_hr_rate,
  least(p_roll30d_hr_allowed / (p_roll30d_pa_faced + 0.000001), CASE WHEN p_roll30d_pa_faced IS NULL THEN NULL ELSE 0.15 END) AS p_roll30d_hr_rate FROM w""")
def _(spark, sf):
    daily = A.opponent_day_agg(li(spark, sf), "opp", "day", "hit", "att", "x", "speed", "kind")
    return R.opponent_rolling(daily, "opp", "day")


HANDS = ["A", "N", "R"]
MIX = f"""mx AS (SELECT opp, day, count(*) FILTER (hand = 'A') AS nA, count(*) FILTER (hand = 'N') AS nN,
  count(*) FILTER (hand = 'R') AS nR FROM li GROUP BY 1, 2), mt AS (SELECT opp, day, sum(nA) OVER w AS a, sum(nN) OVER w AS n,
  sum(nR) OVER w AS r FROM mx WINDOW w AS ({DAYS30.format(k='opp')})), ml AS (SELECT opp, day, lag(a) OVER v AS a,
  lag(n) OVER v AS n, lag(r) OVER v AS r FROM mt WINDOW v AS (PARTITION BY opp ORDER BY day)),
mix AS (SELECT opp, day, coalesce(a / (a + n + r), 0) AS mix_A, coalesce(n / (a + n + r), 0) AS mix_N,
  coalesce(r / (a + n + r), 0) AS mix_R FROM ml)"""


def mix(rows):
    wide = A.category_mix_day(rows, ["opp", "day"], "hand", HANDS)
    return R.rolling_mix_fractions(wide, "opp", "day", {h: f"n_{h}" for h in HANDS})


@query("w6_rolling_mix_fractions", "opp:l day:d mix_A:f mix_N:f mix_R:f", f"WITH {LI}, {MIX} SELECT * FROM mix")
def _(spark, sf):
    return mix(li(spark, sf))


SLG = """sb AS (SELECT ent, day, hand, sum(CASE WHEN inning <= 4 THEN inning ELSE 0 END) AS tb, sum(att) AS ab FROM li GROUP BY 1, 2, 3),
sw AS (SELECT ent, day, {cols} FROM sb GROUP BY 1, 2), slg AS (SELECT ent, day, {vals} FROM sw
  WINDOW w AS (PARTITION BY ent ORDER BY day ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))""".format(
    cols=", ".join(f"coalesce(sum(tb) FILTER (hand = '{h}'), 0) AS tb_{h}, coalesce(sum(ab) FILTER (hand = '{h}'), 0) AS ab_{h}" for h in HANDS),
    vals=", ".join(f"CASE WHEN sum(ab_{h}) OVER w > 0 THEN sum(tb_{h}) OVER w / sum(ab_{h}) OVER w END AS slg_{h}" for h in HANDS))


def bases(rows):
    return rows.groupBy("ent", "day", "hand").agg(
        F.sum(F.when(F.col("inning") <= 4, F.col("inning")).otherwise(0)).alias("tb"), F.sum("att").alias("ab"))


@query("w7_rolling_slg_wide", "ent:l day:d slg_A:f slg_N:f slg_R:f", f"WITH {LI}, {SLG} SELECT * FROM slg")
def _(spark, sf):
    return R.rolling_slg_wide(R.bases_wide(bases(li(spark, sf)), "ent", "day", "hand", HANDS), "ent", "day", HANDS)


@query("w7_rolling_slg_long", "ent:l day:d hand:s slg:f", f"""
WITH {LI}, {SLG} SELECT ent, day, hand, CASE WHEN count(*) OVER v >= 10 THEN sum(tb) OVER v / (sum(ab) OVER v + 0.000001) END AS slg
FROM sb WINDOW v AS (PARTITION BY ent, hand ORDER BY day ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    return R.rolling_slg_long(bases(li(spark, sf)), "ent", "hand", "day")


@query("w8_expected_value_vs_mix", "ent:l opp:l day:d exp_slg_vs_mix:f", f"""
WITH {LI}, {MIX}, {SLG}, g AS (SELECT DISTINCT ent, opp, day FROM li), p AS (SELECT ent, opp, day,
  {' + '.join(f"coalesce(mix_{h} * slg_{h}, 0)" for h in HANDS)} AS top,
  {' + '.join(f"CASE WHEN slg_{h} IS NOT NULL THEN coalesce(mix_{h}, 0) ELSE 0 END" for h in HANDS)} AS bottom
  FROM g LEFT JOIN mix USING (opp, day) LEFT JOIN slg USING (ent, day))
SELECT ent, opp, day, least(greatest(CASE WHEN bottom > 0 THEN top / bottom ELSE 0.4 END, 0), 1) AS exp_slg_vs_mix FROM p""")
def _(spark, sf):
    rows = li(spark, sf)
    slg = R.rolling_slg_wide(R.bases_wide(bases(rows), "ent", "day", "hand", HANDS), "ent", "day", HANDS)
    return R.expected_value_vs_mix(rows.select("ent", "opp", "day").distinct(), mix(rows), slg, "ent", "opp", "day", HANDS)


@query("w9_pair_expanding_lagged", "ent:l opp:l day:d cumulative_pa:l cumulative_hr:l cumulative_ev:f cumulative_la:g "
       "recent_pa:l recent_hr:l", f"""
WITH {LI}, {PAIR_DAY} SELECT ent, opp, day, coalesce(sum(pa) OVER b, 0) AS cumulative_pa, coalesce(sum(hr) OVER b, 0) AS cumulative_hr,
  avg(ev_sum / ev_n) OVER b AS cumulative_ev, avg(la_sum / la_n) OVER b AS cumulative_la, coalesce(sum(pa) OVER r, 0) AS recent_pa,
  coalesce(sum(hr) OVER r, 0) AS recent_hr FROM pd
WINDOW b AS (PARTITION BY ent, opp ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  r AS (PARTITION BY ent, opp ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    return R.pair_expanding_lagged(pair_days(spark, sf), ["ent", "opp"], "day")


def matchup_sql(shift: int) -> str:
    end = f"{shift} PRECEDING" if shift else "CURRENT ROW"
    return f"""WITH {LI}, {PAIR_DAY}, {GAMES}, h AS (SELECT ent, opp, day, coalesce(sum(pa) OVER b, 0) AS cpa, coalesce(sum(hr) OVER b, 0) AS chr,
  avg(ev_sum / ev_n) OVER b AS cev, avg(la_sum / la_n) OVER b AS cla, coalesce(sum(pa) OVER r, 0) AS rpa, coalesce(sum(hr) OVER r, 0) AS rhr
  FROM pd WINDOW b AS (PARTITION BY ent, opp ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND {end}),
  r AS (PARTITION BY ent, opp ORDER BY day ROWS BETWEEN {4 + shift} PRECEDING AND {end}))
SELECT g.ent, g.opp, g.day, coalesce(cpa, 0) AS matchup_pa_career, coalesce(chr, 0) AS matchup_hr_career,
  coalesce(chr, 0) / greatest(coalesce(cpa, 0), 1) AS matchup_hr_rate_career, coalesce(cev, 0) AS matchup_avg_ev_career,
  coalesce(cla, 0) AS matchup_avg_la_career, coalesce(rpa, 0) AS matchup_pa_recent, coalesce(rhr, 0) AS matchup_hr_recent,
  coalesce(rhr, 0) / greatest(coalesce(rpa, 0), 1) AS matchup_hr_rate_recent, coalesce(g.day - h.day, 999) AS matchup_days_since_last,
  (SELECT count(*) FROM pd q WHERE q.ent = g.ent AND q.opp = g.opp AND q.day < g.day AND q.day >= g.day - 365) AS matchup_encounters_last_year,
  least(coalesce(cpa, 0) / 20, 1) AS matchup_familiarity_score
FROM g ASOF LEFT JOIN h ON g.ent = h.ent AND g.opp = h.opp AND g.day > h.day"""


MATCHUP_SPEC = ("ent:l opp:l day:d matchup_pa_career:f matchup_hr_career:f matchup_hr_rate_career:f matchup_avg_ev_career:f "
                "matchup_avg_la_career:g matchup_pa_recent:f matchup_hr_recent:f matchup_hr_rate_recent:f "
                "matchup_days_since_last:f matchup_encounters_last_year:f matchup_familiarity_score:f")


@query("w10_matchup_features", MATCHUP_SPEC, matchup_sql(0))
def _(spark, sf):
    return R.matchup_features(games(li(spark, sf)), pair_days(spark, sf), ["ent", "opp"], "day")


@query("w10_matchup_features_double_lag", MATCHUP_SPEC, matchup_sql(1))
def _(spark, sf):
    return R.matchup_features(games(li(spark, sf)), pair_days(spark, sf), ["ent", "opp"], "day", legacy_double_lag=True)
