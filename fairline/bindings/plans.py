"""X family: whole pipelines on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline import schema
from fairline.bindings.frames import LI, li, odds_board
from fairline.bindings.market import OPPS, SIZED, scored
from fairline.bindings.models import FEATURES, SMALL, rows as model_rows
from fairline.bindings.registry import query, table
from fairline.functions.durable import materialise
from fairline.operators import aggregate as A
from fairline.operators import clean
from fairline.plans import features
from fairline.plans import pipelines as X
from fairline.plans.day_tables import day_tables

TEAMS = sorted(schema.TEAM_STADIUM)
PITCHES = ["EC", "ST", "PR", "SM", "LA", "ME"]


def pitch_events(spark, sf):
    """lineitem as cleaned pitch events: supplier bats for its nation's team against a customer nation's team."""
    rows, x = li(spark, sf), F.col
    team = F.array(*[F.lit(t) for t in TEAMS])
    home, away = F.element_at(team, x("park") + 1), F.element_at(team, x("opp") + 2)
    top = x("inning") % 2 == 0
    return rows.select(
        x("day").alias("date"), x("l_orderkey").alias("game_pk"), x("ent").alias("batter"), x("opp").alias("pitcher"), F.when(top, away).otherwise(home).alias("home_team"),
        F.when(top, home).otherwise(away).alias("away_team"), home.alias("bat_team"), x("inning").cast("int").alias("inning"),
        F.when(x("hand") == "R", "R").when(x("hand") == "A", "L").alias("p_throws"), F.substring("kind", 1, 2).alias("pitch_type"), (x("speed") + 50.0).alias("release_speed"),
        F.when(x("hit") == 1, "home_run").when(x("att") == 1, "field_out").alias("events"), (x("x") * 2).alias("launch_speed"), x("speed").cast("double").alias("launch_angle"),
        ((x("hit") == 1) | (x("att") == 1)).cast("int").alias("is_pa"), x("hit").alias("is_hr"), F.when(x("x") > 30, 1).alias("on_1b"), F.when(x("speed") > 30, 1).alias("on_2b"),
        F.when(x("speed") > 45, 1).alias("on_3b"), (x("speed") % 7).alias("post_home_score"), (x("inning") % 5).alias("post_away_score"), (x("speed") % 4).alias("balls"),
        (x("inning") % 3).alias("strikes"), x("inning").cast("int").alias("at_bat_number"), x("l_partkey").cast("int").alias("pitch_number"))


PE = LI + """, pe AS (SELECT *, CASE WHEN hit = 1 OR att = 1 THEN 1 ELSE 0 END AS pa1 FROM li),
dd AS (SELECT ent, day, sum(pa1) AS pa, sum(hit) AS hr FROM pe GROUP BY 1, 2), r10 AS (SELECT ent, day, sum(pa) OVER w AS roll10_pa, sum(hr) OVER w AS roll10_hr FROM dd
  WINDOW w AS (PARTITION BY ent ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
pf AS (SELECT k.ent, k.day, coalesce(sum(e.hit * exp(-(k.day - e.day) / 14.0)), 0) AS h, coalesce(sum(e.pa1 * exp(-(k.day - e.day) / 14.0)), 0) AS p FROM (SELECT DISTINCT ent, day FROM pe) k
  LEFT JOIN pe e ON e.ent = k.ent AND e.day < k.day AND e.day >= k.day - 60 GROUP BY 1, 2),
gm AS (SELECT day, l_orderkey, ent, inning % 2 AS top, opp, sum(pa1) AS pa, sum(hit) AS hr FROM pe GROUP BY 1, 2, 3, 4, 5)"""


def stored_events(spark, sf):
    """Events as a stored table, which the builder reads as often as it needs to."""
    return materialise(pitch_events(spark, sf))


def park_weather(events):
    """Weather by (date, stadium) from the events; the first days of a month have none."""
    return clean.attach_park(events).where(F.dayofmonth("date") > 3).groupBy("date", "stadium").agg(
        (F.avg("launch_speed") / 2 + 40).alias("temperature"), (F.avg("launch_angle") / 3).alias("wind_speed"), (F.sum("game_pk") % 360).cast("double").alias("wind_direction"),
        (F.avg("inning") * 10).alias("humidity"), (29 + F.avg("is_hr")).alias("pressure"))


CODES = f"t(code, i) AS (VALUES {', '.join(f"('{t}', {i})" for i, t in enumerate(TEAMS))}), sd(code, stadium) AS (VALUES {', '.join(f"('{t}', '{s}')" for t, s in schema.TEAM_STADIUM.items())})"
TEMPERATURE = """CASE WHEN temperature < 70 THEN 0.85 + (temperature - 50) * 0.0075 WHEN temperature < 85 THEN 1 + (temperature - 70) * 0.02 ELSE 1.3 - (temperature - 85) * 0.01 END"""


@query("x1_build_feature_table", "date:d season:i game_pk:l batter:l bat_team:s home_team:s stadium:s home_runs:l hit_hr:i roll10_pa:l roll10_hr:l roll10_hr_rate:f power_form_hr_rate:f "
       "temperature:f temp_hr_factor:f pressure:f games_last_7_days:l", f"""
WITH {PE}, {CODES}, s AS (SELECT DISTINCT s_suppkey, s_nationkey FROM supplier),
wx AS (SELECT day, stadium, avg(x) + 40 AS temperature, 29 + avg(hit) AS pressure FROM (SELECT pe.*, CASE WHEN inning % 2 = 0 THEN a.code ELSE h.code END AS home FROM pe
  JOIN s ON ent = s_suppkey JOIN t h ON h.i = s_nationkey JOIN t a ON a.i = opp + 1) JOIN sd ON sd.code = home WHERE day(day) > 3 GROUP BY 1, 2),
g AS (SELECT gm.day AS date, year(gm.day) - CASE WHEN month(gm.day) <= 2 THEN 1 ELSE 0 END AS season, l_orderkey AS game_pk, gm.ent AS batter, h.code AS bat_team, CASE WHEN top = 0 THEN a.code ELSE h.code END AS home_team, sd.stadium, hr AS home_runs,
  CASE WHEN hr > 0 THEN 1 ELSE 0 END AS hit_hr, roll10_pa, roll10_hr, CASE WHEN roll10_pa IS NOT NULL THEN least(roll10_hr / (roll10_pa + 0.000001), 0.25) END AS roll10_hr_rate,
  least(CASE WHEN pf.p > 0 THEN pf.h / pf.p ELSE 0 END, 0.25) AS power_form_hr_rate
  FROM gm JOIN r10 ON gm.ent = r10.ent AND gm.day = r10.day JOIN pf ON gm.ent = pf.ent AND gm.day = pf.day JOIN s ON gm.ent = s_suppkey JOIN t h ON h.i = s_nationkey JOIN t a ON a.i = gm.opp + 1
  JOIN sd ON sd.code = CASE WHEN top = 0 THEN a.code ELSE h.code END),
w AS (SELECT g.*, coalesce(temperature, 72) AS temperature, coalesce(pressure, 29.92) AS pressure FROM g LEFT JOIN wx ON wx.day = g.date AND wx.stadium = g.stadium)
SELECT *, least(greatest({TEMPERATURE}, 0.7), 1.4) AS temp_hr_factor, count(*) OVER (PARTITION BY batter ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS games_last_7_days FROM w""")
def _(spark, sf):
    events = stored_events(spark, sf)
    return X.final_table(X.build_feature_table(events, PITCHES, park_weather(events)))


def days_of(spark, sf, *wanted):
    parts, _ = features._shared_parts(features._rates())
    return day_tables(features.prepared_events(pitch_events(spark, sf)), features.LAUNCH, PITCHES, parts, wanted=wanted)


HAND = "CASE WHEN hand = 'A' THEN 'L' ELSE 'R' END"
_BATTER = f"""SELECT day AS date, ent AS batter, count(*) AS n, sum(pa1) AS pa, sum(hit) AS hr, sum(x * 2) AS launch_speed_sum, sum(speed) AS launch_angle_sum, count(*) AS launch_angle_n,
  sum(speed * speed) AS la2, count(*) FILTER (x * 2 >= 95) AS hard, count(*) FILTER (x * 2 >= 98 AND speed BETWEEN 25 AND 35) AS barrel, count(*) FILTER (speed BETWEEN 8 AND 32) AS sweet,
  count(*) FILTER (speed BETWEEN 10 AND 25) AS line, {', '.join(f"coalesce(sum(4 * hit) FILTER (kind[1:2] = '{k}'), 0) AS tb_{k}, count(*) FILTER (kind[1:2] = '{k}' AND pa1 = 1) AS ab_{k}" for k in PITCHES)}
  FROM pe GROUP BY 1, 2"""
_PITCHER = f"""SELECT day AS date, opp AS pitcher, sum(pa1) AS pa, sum(hit) AS hr, count(*) AS pitches, sum(x * 2) AS launch_speed_sum, sum(speed + 50) AS release_speed_sum,
  {', '.join(f"count(*) FILTER (kind[1:2] = '{k}') AS n_{k}" for k in PITCHES)} FROM pe GROUP BY 1, 2"""
_PROFILE = f"""SELECT opp AS pitcher, {HAND} AS hand, count(*) AS past_n, sum(speed + 50) AS past_speed_sum FROM pe GROUP BY 1, 2"""
_GRAINS = {
    "batter": ("date:d batter:l n:l pa:l hr:l launch_speed_sum:f launch_angle_sum:f launch_angle_n:l la2:f hard:l barrel:l sweet:l line:l " + " ".join(f"tb_{k}:l ab_{k}:l" for k in PITCHES), _BATTER),
    "hand": ("date:d batter:l hand:s pa:l hr:l launch_speed_sum:f", f"SELECT day AS date, ent AS batter, {HAND} AS hand, sum(pa1) AS pa, sum(hit) AS hr, sum(x * 2) AS launch_speed_sum FROM pe GROUP BY 1, 2, 3"),
    "pitcher": ("date:d pitcher:l pa:l hr:l pitches:l launch_speed_sum:f release_speed_sum:f " + " ".join(f"n_{k}:l" for k in PITCHES), _PITCHER),
    "pair": ("date:d batter:l pitcher:l n:l pa:l hr:l launch_angle_sum:f", "SELECT day AS date, ent AS batter, opp AS pitcher, count(*) AS n, sum(pa1) AS pa, sum(hit) AS hr, sum(speed) AS launch_angle_sum FROM pe GROUP BY 1, 2, 3"),
    "profile": ("pitcher:l hand:s past_n:l past_speed_sum:f", _PROFILE),
    "game": ("date:d game_pk:l batter:l pa:l hr:l", "SELECT day AS date, l_orderkey AS game_pk, ent AS batter, pa, hr FROM gm"),
}


def _grain(name: str, spec: str, sql: str) -> None:
    @query(f"x1_days_{name}", spec, f"WITH {PE} {sql}")
    def _(spark, sf):
        return days_of(spark, sf, name)[name]


for _name, (_spec, _sql) in _GRAINS.items():
    _grain(_name, _spec, _sql)


@query("x1_block_handedness", "batter:l date:d R_pa10:l R_hr10:l R_hr_rate10:f R_ev10:f L_pa10:l L_hr_rate10:f L_pa30d:l", f"""
WITH {PE}, h AS (SELECT ent, {HAND} AS h, day, sum(pa1) AS pa, sum(hit) AS hr, avg(x * 2) AS ev FROM pe GROUP BY 1, 2, 3),
r AS (SELECT ent, h, day, sum(pa) OVER w AS pa10, sum(hr) OVER w AS hr10, avg(ev) OVER w AS ev10, sum(pa) OVER (PARTITION BY ent, h ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS d30 FROM h
  WINDOW w AS (PARTITION BY ent, h ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), q AS (SELECT *, lag(d30) OVER (PARTITION BY ent, h ORDER BY day) AS pa30d FROM r)
SELECT ent AS batter, day AS date, max(pa10) FILTER (h = 'R') AS R_pa10, max(hr10) FILTER (h = 'R') AS R_hr10, max(hr10 / (pa10 + 0.000001)) FILTER (h = 'R') AS R_hr_rate10, max(ev10) FILTER (h = 'R') AS R_ev10,
  max(pa10) FILTER (h = 'L') AS L_pa10, max(hr10 / (pa10 + 0.000001)) FILTER (h = 'L') AS L_hr_rate10, max(pa30d) FILTER (h = 'L') AS L_pa30d FROM q GROUP BY 1, 2""")
def _(spark, sf):
    return features.hand_block(days_of(spark, sf, "hand")["hand"])


@query("x1_block_pitcher", "pitcher:l date:d p_roll10_hr_allowed:l p_roll10_pa_faced:l p_roll10_hr_rate:f p_roll10_vel:f mix_EC:f mix_ST:f", f"""
WITH {PE}, d AS (SELECT opp, day, sum(hit) AS hr, sum(pa1) AS pa, avg(speed + 50) AS vel, count(*) AS n, count(*) FILTER (kind[1:2] = 'EC') AS ec, count(*) FILTER (kind[1:2] = 'ST') AS st FROM pe GROUP BY 1, 2),
r AS (SELECT opp, day, sum(hr) OVER w AS hr, sum(pa) OVER w AS pa, avg(vel) OVER w AS vel, sum(n) OVER m AS n, sum(ec) OVER m AS ec, sum(st) OVER m AS st FROM d
  WINDOW w AS (PARTITION BY opp ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), m AS (PARTITION BY opp ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)),
l AS (SELECT *, lag(n) OVER w AS ln, lag(ec) OVER w AS lec, lag(st) OVER w AS lst FROM r WINDOW w AS (PARTITION BY opp ORDER BY day))
SELECT opp AS pitcher, day AS date, hr AS p_roll10_hr_allowed, pa AS p_roll10_pa_faced, CASE WHEN pa IS NOT NULL THEN least(hr / (pa + 0.000001), 0.15) END AS p_roll10_hr_rate, vel AS p_roll10_vel,
  coalesce(lec / ln, 0) AS mix_EC, coalesce(lst / ln, 0) AS mix_ST FROM l""")
def _(spark, sf):
    days = days_of(spark, sf, "pitcher")["pitcher"]
    return features.pitcher_block(days).join(features.mix_block(days, PITCHES), ["pitcher", "date"])


@query("x1_block_matchup", "batter:l opp_starter:l date:d matchup_pa_career:f matchup_hr_career:f matchup_days_since_last:f vs_similar_hand_pa:l vs_similar_hand_hr:l vs_similar_velocity_pa:l", f"""
WITH {PE}, d AS (SELECT ent, opp, day, sum(pa1) AS pa, sum(hit) AS hr FROM pe GROUP BY 1, 2, 3), hc AS (SELECT opp, {HAND} AS h, count(*) AS n FROM pe GROUP BY 1, 2),
hm AS (SELECT opp, h FROM hc QUALIFY row_number() OVER (PARTITION BY opp ORDER BY n DESC, h) = 1), vt AS (SELECT opp, CASE WHEN avg(speed + 50) > 94 THEN 'high' WHEN avg(speed + 50) > 90 THEN 'medium' ELSE 'low' END AS v FROM pe GROUP BY 1),
k AS (SELECT d.*, h, v FROM d JOIN hm USING (opp) JOIN vt USING (opp))
SELECT a.ent AS batter, a.opp AS opp_starter, a.day AS date, coalesce(sum(b.pa) FILTER (b.opp = a.opp), 0) AS matchup_pa_career, coalesce(sum(b.hr) FILTER (b.opp = a.opp), 0) AS matchup_hr_career,
  coalesce(datediff('day', max(b.day) FILTER (b.opp = a.opp), a.day), 999) AS matchup_days_since_last, coalesce(sum(b.pa) FILTER (b.opp <> a.opp AND b.h = a.h), 0) AS vs_similar_hand_pa,
  coalesce(sum(b.hr) FILTER (b.opp <> a.opp AND b.h = a.h), 0) AS vs_similar_hand_hr, coalesce(sum(b.pa) FILTER (b.opp <> a.opp AND b.v = a.v), 0) AS vs_similar_velocity_pa
FROM k a LEFT JOIN k b ON a.ent = b.ent AND b.day < a.day GROUP BY 1, 2, 3""")
def _(spark, sf):
    days = days_of(spark, sf, "pair", "profile")
    spine = days["pair"].select("batter", F.col("pitcher").alias("opp_starter"), "date")
    return features.matchup_block(spine, days["pair"], features.profiles_of(days["profile"]))


@query("x1_block_situational", "batter:l date:d avg_runners_on_base:f trailing_percentage:f late_inning_pa_percentage:f overall_hr_rate:f clutch_hr_rate:f two_strike_hr_rate:f", f"""
WITH {PE}, e AS (SELECT *, (speed % 7 - inning % 5) * CASE WHEN inning % 2 = 0 AND opp + 1 <> park THEN -1 ELSE 1 END AS diff, CASE WHEN x > 30 THEN 1 ELSE 0 END + CASE WHEN speed > 30 THEN 1 ELSE 0 END + CASE WHEN speed > 45 THEN 1 ELSE 0 END AS runners FROM pe),
d AS (SELECT ent, day, sum(pa1) AS pa, sum(pa1 * runners) AS r, count(*) FILTER (pa1 = 1 AND diff < 0) AS t, count(*) FILTER (pa1 = 1 AND inning >= 7) AS late, sum(pa1 * hit) AS hr,
  count(*) FILTER (pa1 = 1 AND inning >= 7 AND abs(diff) <= 3 AND runners > 0) AS c, coalesce(sum(hit) FILTER (pa1 = 1 AND inning >= 7 AND abs(diff) <= 3 AND runners > 0), 0) AS ch,
  count(*) FILTER (inning % 3 = 2) AS two, coalesce(sum(hit) FILTER (inning % 3 = 2), 0) AS twoh FROM e GROUP BY 1, 2),
b AS (SELECT ent, day, sum(pa) OVER w AS pa, sum(r) OVER w AS r, sum(t) OVER w AS t, sum(late) OVER w AS late, sum(hr) OVER w AS hr, sum(c) OVER w AS c, sum(ch) OVER w AS ch, sum(two) OVER w AS two, sum(twoh) OVER w AS twoh FROM d
  WINDOW w AS (PARTITION BY ent ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ent AS batter, day AS date, coalesce(r / nullif(pa, 0), 0) AS avg_runners_on_base, coalesce(t / nullif(pa, 0), 0.33) AS trailing_percentage, coalesce(late / nullif(pa, 0), 0) AS late_inning_pa_percentage,
  coalesce(hr / nullif(pa, 0), 0) AS overall_hr_rate, coalesce(ch / nullif(c, 0), hr / nullif(pa, 0), 0) AS clutch_hr_rate, coalesce(twoh / nullif(two, 0), 0) AS two_strike_hr_rate FROM b""")
def _(spark, sf):
    rates = features._rates()
    _, place = features._shared_parts(rates)
    return A.rates_before(days_of(spark, sf, "batter")["batter"], "batter", "date", rates, parts=place)


@query("x2_build_prediction_table", "target:s last_offer:l recent_total:f recent_rows:l", """
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS d FROM orders), r AS (SELECT 'PLAYER ' || CASE WHEN c_acctbal > 5000 THEN '' ELSE 'x' END || c_custkey || '#' AS target, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY c_custkey ORDER BY d DESC, o_orderkey DESC) AS k FROM o JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND d >= (SELECT max(d) FROM o) - 400)
SELECT target, max(CASE WHEN k = 1 THEN o_orderkey END) AS last_offer, avg(o_totalprice) AS recent_total, count(*) AS recent_rows FROM r WHERE k <= 10 GROUP BY 1""")
def _(spark, sf):
    history = odds_board(spark, sf).select(F.col("offer").alias("last_offer"), F.concat(F.lit("Jr Player "), "player", F.lit("#")).alias("name"), "date", "total")
    targets = table(spark, sf, "customer").select(F.concat(F.lit("PLAYER "), F.when(F.col("c_acctbal") > 5000, "").otherwise("x"), "c_custkey", F.lit("#")).alias("target"))
    return X.build_prediction_table(history, targets, "name", "target", "date", [F.desc("date"), F.desc("last_offer")], ["last_offer"], ["total"], days=400)


@query("x2_prediction_defaults", "target:s last_offer:l recent_total:f era:f streak:f", """
WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS o_totalprice, CAST(o_orderdate AS DATE) AS d FROM orders),
r AS (SELECT 'PLAYER ' || c_custkey || '#' AS target, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY d DESC, o_orderkey DESC) AS k
  FROM o JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND d >= (SELECT max(d) FROM o) - 400),
t AS (SELECT target, max(CASE WHEN k = 1 THEN o_orderkey END) AS last_offer, avg(o_totalprice) AS recent_total FROM r WHERE k <= 10 GROUP BY 1)
SELECT target, last_offer, coalesce(recent_total, (SELECT quantile_cont(recent_total, 0.5) FROM t)) AS recent_total, 4.5 AS era, 0 AS streak FROM t""")
def _(spark, sf):
    """Missing prices become the median, absent columns their default or zero."""
    board = odds_board(spark, sf)
    history = board.select(F.col("offer").alias("last_offer"), F.concat(F.lit("Jr Player "), "player", F.lit("#")).alias("name"), "date", F.when(F.col("offer") % 4 != 0, F.col("total")).alias("total"))
    targets = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("PLAYER "), "c_custkey", F.lit("#")).alias("target"))
    return X.build_prediction_table(history, targets, "name", "target", "date", [F.desc("date"), F.desc("last_offer")], ["last_offer"], ["total"], days=400,
                                    defaults={"era": clean.LEAGUE_DEFAULTS["era"]}, median_columns=("recent_total",), zero_columns=("streak",))


def report(spark, sf):
    board = odds_board(spark, sf)
    name = F.concat(F.lit("Player "), "offer").alias("batter_name")
    predictions = board.select("offer", "date", name, F.round("p", 3).alias("score"))
    odds = board.select("date", name, "odds_yes", "odds_no", "bookmaker")
    return X.daily_opportunities(predictions, odds, "date", "batter_name", "score", "odds_yes", "odds_no", "offer")


CAL = """v AS (SELECT o_orderkey AS offer, round(o_totalprice / 1000000.0, 3) AS q FROM orders), rk AS (SELECT offer, (rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0)
  / count(*) OVER () AS s FROM v), cal AS (SELECT offer, CASE WHEN s <= 0.5 THEN 0.05 + s * 0.14 WHEN s <= 0.75 THEN 0.12 + (s - 0.5) * 0.24 WHEN s <= 0.9 THEN 0.18 + (s - 0.75) * 7 / 15
  WHEN s <= 0.95 THEN 0.25 + (s - 0.9) WHEN s <= 0.99 THEN 0.3 + (s - 0.95) * 1.25 ELSE 0.35 END AS c FROM rk)"""
X3 = f"""WITH {OPPS.split(', pr AS')[0]}, {CAL}, x AS (SELECT board.*, c, CASE WHEN odds_yes >= 0 THEN odds_yes / 100 ELSE 100 / -odds_yes END AS b FROM board JOIN cal USING (offer)),
y AS (SELECT *, c * b - (1 - c) AS expected_value, least(greatest((b * c - (1 - c)) / b, 0), 1) AS kelly FROM x WHERE odds_yes IS NOT NULL)"""


@query("x3_daily_opportunities", "offer:l bookmaker:s model_probability:f expected_value:f kelly_fraction:f confidence_score:f", f"""
{X3} SELECT offer, bookmaker, c AS model_probability, expected_value, least(kelly, 0.25) AS kelly_fraction, least(greatest(least(10 * expected_value, 5) + CASE WHEN c BETWEEN 0.08 AND 0.2 THEN 2 ELSE 0 END
  - CASE WHEN kelly > 0.15 THEN 1 ELSE 0 END, 0), 10) AS confidence_score FROM y WHERE c >= 0.06 AND expected_value >= 0.05""")
def _(spark, sf):
    return report(spark, sf).opportunities


@query("x3_daily_summary", "total_players_with_odds:l total_opportunities:l opportunity_rate:f avg_model_probability:f positive_ev_count:l best_ev:f", f"""
{X3} SELECT count(*) AS total_players_with_odds, count(*) FILTER (c >= 0.06 AND expected_value >= 0.05) AS total_opportunities, count(*) FILTER (c >= 0.06 AND expected_value >= 0.05) / count(*) AS opportunity_rate,
  avg(c) AS avg_model_probability, count(*) FILTER (expected_value > 0) AS positive_ev_count, max(expected_value) AS best_ev FROM y""")
def _(spark, sf):
    return report(spark, sf).summary


@query("x4_train_and_evaluate", "model:s n:l roc_auc:f log_loss:f brier_score:f ece:f mce:f")
def _(spark, sf):
    result = X.train_and_evaluate(model_rows(spark, sf), FEATURES, "label", "date", ("logistic", "boosted"), SMALL, threshold=0.35)
    return result.metrics.join(result.calibration, "model")


@query("x5_portfolio", "offer:l date:d recommended_bet:f expected_profit:f", f"""
WITH {OPPS}, {SIZED} SELECT offer, date, greatest(0, least(wanted, 100 - spent)) AS recommended_bet, expected_value * greatest(0, least(wanted, 100 - spent)) AS expected_profit FROM s WHERE spent < 100""")
def _(spark, sf):
    return X.portfolio(scored(spark, sf), "p", "odds_yes", "date", "offer")
