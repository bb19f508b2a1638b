"""W11-W16 on lineitem (several years, so look-back windows really expire)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.bindings.frames import EV, LI, ev, li
from fairline.bindings.registry import query
from fairline.operators import form as W

SRC = LI + """, e AS (SELECT ent, day, att, hit, CASE WHEN kind <> 'ECONOMY' THEN x * 2 + 0.5 END AS v,
  CASE WHEN hand <> 'N' THEN CAST(speed AS DOUBLE) END AS g, CASE WHEN inning % 2 = 0 THEN 1 ELSE 0 END AS zone,
  CASE WHEN inning % 3 > 0 THEN 1 ELSE 0 END AS swing, CASE WHEN x < 15 THEN 1 ELSE 0 END AS whiff FROM li),
k AS (SELECT DISTINCT ent, day FROM e)"""
KEYS = "ent:l day:d "


def source(spark, sf):
    return li(spark, sf).select(
        "ent", "day", "att", "hit", F.when(F.col("kind") != "ECONOMY", F.col("x") * 2 + 0.5).alias("v"),
        F.when(F.col("hand") != "N", F.col("speed").cast("double")).alias("g"),
        (F.col("inning") % 2 == 0).cast("int").alias("zone"), (F.col("inning") % 3 > 0).cast("int").alias("swing"),
        (F.col("x") < 15).cast("int").alias("whiff"))


def days(spark, sf, swings=False, barrel=(25, 35)):
    extra = ("zone", "swing", "whiff") if swings else (None, None, None)
    return W.form_days(source(spark, sf), "ent", "day", "att", "hit", "v", "g", *extra, barrel=barrel)


def decayed(weight: str, span: int, columns: str) -> str:
    return (f"WITH {SRC}, j AS (SELECT k.ent, k.day, e.att, e.hit, e.v, e.g, e.zone, e.swing, e.whiff, CASE WHEN e.day IS NOT NULL THEN {weight} END AS w FROM k LEFT JOIN e ON "
            f"e.ent = k.ent AND e.day >= k.day - {span} AND e.day < k.day) SELECT ent, day, {columns} FROM j GROUP BY 1, 2")


EXP14 = "greatest(exp(-(k.day - e.day) / 14.0), 0.01)"


def half(days_: int, floor: float) -> str:
    return f"greatest(exp(-ln(2.0) * (k.day - e.day) / {days_}.0), {floor})"


def share(top: str, bottom: str, floor: bool = False) -> str:
    b = f"sum(CASE WHEN {bottom} THEN w ELSE 0 END)"
    t = f"coalesce(sum(w * ({top})), 0)"
    return f"{t} / greatest(coalesce({b}, 0), 1)" if floor else f"coalesce(CASE WHEN {b} > 0 THEN {t} / {b} END, 0)"


def one(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


@query("w11_decay_weight", "event_id:l recent:f power:f contact:f discipline:f hot_cold:f", f"""
WITH {EV}, a AS (SELECT event_id, CAST((SELECT max(day) FROM ev) - day AS DOUBLE) * 4 AS d FROM ev)
SELECT event_id, greatest(exp(-d / 14), 0.01) AS recent, greatest(pow(2, -d / 14), 0.05) AS power, greatest(pow(2, -d / 21), 0.03) AS contact,
  greatest(pow(2, -d / 28), 0.02) AS discipline, greatest(pow(2, -d / 7), 0.1) AS hot_cold FROM a""")
def _(spark, sf):
    rows = ev(spark, sf)
    newest = rows.agg(F.max("day").alias("m")).scalar()
    d = F.datediff(newest, F.col("day")) * 4
    return rows.select("event_id", *[W.decay_weight(d, c).alias(n) for n, c in [
        ("recent", W.RECENT), ("power", W.POWER), ("contact", W.CONTACT), ("discipline", W.DISCIPLINE), ("hot_cold", W.HOT_COLD)]])


POWER = "power_form_hr_rate:f power_form_avg_ev:f power_form_hard_hit_rate:f power_form_barrel_rate:f power_form_iso_power:f"


@query("w12_decayed_power_form", KEYS + POWER, decayed(EXP14, 60, f"""
{share('hit', 'att = 1')} AS power_form_hr_rate, {share('coalesce(v, 0)', 'v IS NOT NULL')} AS power_form_avg_ev,
{share(one('v >= 95'), 'v IS NOT NULL')} AS power_form_hard_hit_rate, {share(one('v >= 98 AND g BETWEEN 25 AND 35'), 'w > 0')} AS power_form_barrel_rate,
3 * {share('hit', 'w > 0')} AS power_form_iso_power"""))
def _(spark, sf):
    return W.decayed_power_form(days(spark, sf), "ent")


@query("w12_decayed_power_form_base", KEYS + POWER.replace(" power_form_iso_power:f", ""), decayed(half(14, 0.05), 60, f"""
{share('hit', 'att = 1', True)} AS power_form_hr_rate, {share('coalesce(v, 0)', 'v IS NOT NULL', True)} AS power_form_avg_ev,
{share(one('v >= 95'), 'v IS NOT NULL', True)} AS power_form_hard_hit_rate,
{share(one('v >= 98 AND g BETWEEN 20 AND 35'), 'v IS NOT NULL', True)} AS power_form_barrel_rate"""))
def _(spark, sf):
    return W.decayed_power_form(days(spark, sf, barrel=(20, 35)), "ent", W.POWER, floored=True)


CONTACT = "contact_form_avg_la:f contact_form_sweet_spot_rate:f contact_form_line_drive_rate:f contact_form_consistency:f"


@query("w13_decayed_contact_form", KEYS + CONTACT, decayed(EXP14, 60, f"""
{share('coalesce(g, 0)', 'g IS NOT NULL')} AS contact_form_avg_la, {share(one('g BETWEEN 8 AND 32'), 'g IS NOT NULL')} AS contact_form_sweet_spot_rate,
{share(one('g BETWEEN 10 AND 25'), 'g IS NOT NULL')} AS contact_form_line_drive_rate, CASE WHEN count(g) >= 5 THEN 1 / (1 + sqrt(greatest(0,
sum(w * g * g) / sum(CASE WHEN g IS NOT NULL THEN w END) - (sum(w * g) / sum(CASE WHEN g IS NOT NULL THEN w END)) ** 2))) ELSE 0 END AS contact_form_consistency"""))
def _(spark, sf):
    return W.decayed_contact_form(days(spark, sf), "ent")


@query("w13_decayed_contact_form_base", KEYS + CONTACT, f"""
WITH {SRC}, j AS (SELECT k.ent, k.day, g, {half(21, 0.03)} AS w FROM k LEFT JOIN e ON e.ent = k.ent AND e.day >= k.day - 75 AND e.day < k.day
  AND g IS NOT NULL), m AS (SELECT ent, day, coalesce(sum(w * g), 0) / greatest(coalesce(sum(w), 0), 1) AS mu FROM j GROUP BY 1, 2)
SELECT ent, day, any_value(mu) AS contact_form_avg_la, coalesce(sum(w * {one('g BETWEEN 8 AND 32')}), 0) / greatest(coalesce(sum(w), 0), 1) AS contact_form_sweet_spot_rate,
  coalesce(sum(w * {one('g BETWEEN 10 AND 25')}), 0) / greatest(coalesce(sum(w), 0), 1) AS contact_form_line_drive_rate,
  CASE WHEN count(g) > 3 THEN 1 / (1 + sqrt(sum(w * (g - mu) ** 2) / greatest(sum(w), 1)) / 10) ELSE 0 END AS contact_form_consistency
FROM j JOIN m USING (ent, day) GROUP BY 1, 2""")
def _(spark, sf):
    return W.decayed_contact_form(days(spark, sf), "ent", W.CONTACT, floored=True)


DISC = "discipline_form_contact_rate:f discipline_form_z_contact_rate:f discipline_form_chase_rate:f discipline_form_whiff_rate:f"


@query("w14_discipline_form", KEYS + DISC, decayed(EXP14, 60, f"""
{share(one('swing = 1 AND whiff = 0'), 'swing = 1')} AS discipline_form_contact_rate,
{share(one('zone = 1 AND swing = 1 AND whiff = 0'), 'zone = 1 AND swing = 1')} AS discipline_form_z_contact_rate,
{share(one('zone = 0 AND swing = 1'), 'zone = 0')} AS discipline_form_chase_rate, {share(one('swing = 1 AND whiff = 1'), 'swing = 1')} AS discipline_form_whiff_rate"""))
def _(spark, sf):
    return W.discipline_form(days(spark, sf, swings=True), "ent")


@query("w14_discipline_form_proxy", KEYS + DISC, decayed(EXP14, 60, """
CASE WHEN count(att) >= 10 THEN coalesce(1 / (1 + stddev_samp(g) / 30), 0) ELSE 0 END AS discipline_form_contact_rate,
CASE WHEN count(att) >= 10 THEN coalesce(1 / (1 + stddev_samp(g) / 25), 0) ELSE 0 END AS discipline_form_z_contact_rate,
CASE WHEN count(att) >= 10 THEN coalesce(stddev_samp(g) / 50, 0) ELSE 0 END AS discipline_form_chase_rate,
CASE WHEN count(att) >= 10 THEN coalesce(stddev_samp(g) / 45, 0) ELSE 0 END AS discipline_form_whiff_rate"""))
def _(spark, sf):
    return W.discipline_form(days(spark, sf), "ent")


IND = "hot_streak_indicator:f cold_streak_indicator:f recent_power_surge:f momentum_score:f"


@query("w15_recent_n_indicators", "user_id:l day:d recent_slump_indicator:f " + IND, f"""
WITH {EV}, k AS (SELECT DISTINCT user_id, day FROM ev), e AS (SELECT *, CASE WHEN event_type <> 'error' THEN x + 45 END AS v FROM ev),
j AS (SELECT k.user_id, k.day, e.hit, e.v, row_number() OVER (PARTITION BY k.user_id, k.day ORDER BY ts DESC, event_id DESC) AS r,
  row_number() OVER (PARTITION BY k.user_id, k.day, v IS NOT NULL ORDER BY ts DESC, event_id DESC) AS rv, e.event_id
  FROM k LEFT JOIN e ON e.user_id = k.user_id AND e.day >= k.day - 60 AND e.day < k.day),
s AS (SELECT user_id, day, count(event_id) AS n, avg(hit) FILTER (r <= 10) AS rate, avg(v) FILTER (rv <= 10 AND v IS NOT NULL) AS ev,
  count(v) AS nv, avg(hit) FILTER (r <= 5) AS h5, avg(hit) FILTER (r BETWEEN 16 AND 20) AS o5 FROM j GROUP BY 1, 2)
SELECT user_id, day, CASE WHEN n >= 10 THEN greatest(0, (rate - 0.12) * 10) ELSE 0 END AS hot_streak_indicator,
  CASE WHEN n >= 10 THEN greatest(0, (0.08 - rate) * 10) ELSE 0 END AS cold_streak_indicator,
  CASE WHEN n >= 10 THEN greatest(0, (0.05 - rate) * 10) ELSE 0 END AS recent_slump_indicator,
  CASE WHEN n >= 10 AND nv >= 5 THEN greatest(0, (ev - 88) / 10) ELSE 0 END AS recent_power_surge,
  CASE WHEN n >= 20 THEN tanh(10 * (h5 - o5)) ELSE 0 END AS momentum_score FROM s""")
def _(spark, sf):
    rows = ev(spark, sf).withColumn("v", F.when(F.col("event_type") != "error", F.col("x") + 45))
    return W.recent_n_indicators(rows, "user_id", "day", ["ts", "event_id"], "hit", "v")


@query("w15_decayed_indicators", KEYS + IND, f"""
SELECT *, tanh(hot_streak_indicator - cold_streak_indicator + recent_power_surge) AS momentum_score FROM ({decayed(half(7, 0.1), 30, f'''
CASE WHEN sum(w) > 0 THEN greatest(0, ({share('hit', 'att = 1', True)} - 0.12) * 10) ELSE 0 END AS hot_streak_indicator,
CASE WHEN sum(w) > 0 THEN greatest(0, (0.08 - {share('hit', 'att = 1', True)}) * 10) ELSE 0 END AS cold_streak_indicator,
CASE WHEN count(v) > 0 THEN greatest(0, ({share('coalesce(v, 0)', 'v IS NOT NULL', True)} - 88) / 10) ELSE 0 END AS recent_power_surge''')})""")
def _(spark, sf):
    return W.decayed_indicators(days(spark, sf), "ent")


TRENDS = [f"hr_rate_trend_{n}d" for n in (7, 14, 30)] + [f"ev_trend_{n}d" for n in (7, 14, 30)]


def _trend(n: int) -> str:
    frame = f"OVER (PARTITION BY ent ORDER BY dn RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    guard = f"sum(n) {frame} >= 5 AND count(*) {frame} >= 3"
    return (f"coalesce(CASE WHEN {guard} THEN 100 * regr_slope(rate, dn) {frame} END, 0) AS hr_rate_trend_{n}d, "
            f"coalesce(CASE WHEN {guard} AND count(ev) {frame} >= 3 THEN regr_slope(ev, dn) {frame} END, 0) AS ev_trend_{n}d")


@query("w16_trend_slopes", KEYS + " ".join(f"{t}:f" for t in TRENDS) + " form_acceleration:f", f"""
WITH {SRC}, dd AS (SELECT ent, day, datediff('day', DATE '1995-01-01', day) AS dn, count(*) AS n, sum(hit) / greatest(sum(att), 1) AS rate,
  avg(v) AS ev FROM e GROUP BY 1, 2, 3), t AS (SELECT ent, day, {_trend(7)}, {_trend(14)}, {_trend(30)} FROM dd)
SELECT *, hr_rate_trend_7d - hr_rate_trend_14d AS form_acceleration FROM t""")
def _(spark, sf):
    return W.trend_slopes(days(spark, sf), "ent")
