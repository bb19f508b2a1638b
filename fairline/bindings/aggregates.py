"""A family (entity, opponent and situation aggregates) on events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.bindings.frames import EV, LI, ev, li
from fairline.bindings.registry import query, table
from fairline.operators import aggregate as A


@query("a1_entity_game_agg", "user_id:l day:d pa:l hr:l x:f angle:f hit_hr:i", f"""
WITH {EV} SELECT user_id, day, sum(att) AS pa, sum(hit) AS hr, avg(x) AS x, avg(angle) AS angle,
  CASE WHEN sum(hit) > 0 THEN 1 ELSE 0 END AS hit_hr FROM ev GROUP BY 1, 2""")
def _(spark, sf):
    return A.entity_game_agg(ev(spark, sf), ["user_id", "day"], {"pa": "att", "hr": "hit"},
                             {"x": "x", "angle": "angle", "swing": "bat_speed"}, ("hr", "hit_hr"))


@query("a2_split_day_agg", "ent:l hand:s day:d pa:l hr:l x:f", f"""
WITH {LI} SELECT ent, coalesce(nullif(hand, 'N'), 'R') AS hand, day, sum(att) AS pa, sum(hit) AS hr, avg(x) AS x
FROM li GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = li(spark, sf).withColumn("hand", F.nullif(F.col("hand"), F.lit("N")))
    return A.split_day_agg(rows, "ent", "hand", "day", {"pa": "att", "hr": "hit"}, {"x": "x"})


@query("a3_opponent_day_agg", "opp:l day:d hr_allowed:l pa_faced:l ev_allowed:f vel:f pitches:l", f"""
WITH {LI} SELECT opp, day, sum(hit) AS hr_allowed, sum(att) AS pa_faced, avg(x) AS ev_allowed, avg(speed) AS vel,
  count(kind) AS pitches FROM li GROUP BY 1, 2""")
def _(spark, sf):
    return A.opponent_day_agg(li(spark, sf), "opp", "day", "hit", "att", "x", "speed", "kind")


@query("a4_category_mix_day", "opp:l day:d n_A:l n_N:l n_R:l", f"""
WITH {LI} SELECT opp, day, count(*) FILTER (hand = 'A') AS n_A, count(*) FILTER (hand = 'N') AS n_N,
  count(*) FILTER (hand = 'R') AS n_R FROM li GROUP BY 1, 2""")
def _(spark, sf):
    return A.category_mix_day(li(spark, sf), ["opp", "day"], "hand", ["A", "N", "R"])


@query("a4_category_counts_long", "opp:l day:d kind:s n:l", f"""
WITH {LI} SELECT opp, day, kind, count(*) AS n FROM li GROUP BY 1, 2, 3""")
def _(spark, sf):
    return A.category_counts(li(spark, sf), ["opp", "day"], "kind")


@query("a5_bases_by_category_day", "user_id:l day:d kind:i tb:l ab:l", f"""
WITH {EV} SELECT user_id, day, CAST(angle AS INTEGER) % 3 AS kind,
  sum(CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 4 ELSE 0 END) AS tb,
  count(*) FILTER (event_type IN ('click', 'signup', 'purchase', 'error')) AS ab FROM ev GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = ev(spark, sf).withColumn("kind", F.col("angle").cast("int") % 3)
    return A.bases_by_category_day(rows, ["user_id", "day"], "kind", "event_type",
                                   {"click": 1, "signup": 2, "purchase": 4}, ["click", "signup", "purchase", "error"])


@query("a6_first_per_group", "l_orderkey:l starter:l", f"""
WITH {LI} SELECT l_orderkey, first(ent ORDER BY inning, day, l_partkey, ent) AS starter FROM li GROUP BY 1""")
def _(spark, sf):
    return A.first_per_group(li(spark, sf), ["l_orderkey"], "ent", ["inning", "day", "l_partkey", "ent"], "starter")


PROFILE = """prof AS (SELECT opp, coalesce(v, 92) AS avg_velocity, coalesce(h, 'R') AS handedness,
  coalesce(k, 'FF') AS primary_pitch, CASE WHEN coalesce(v, 92) > 25.6 THEN 'high' WHEN coalesce(v, 92) > 25.4
  THEN 'medium' ELSE 'low' END AS velocity_tier FROM
  (SELECT opp, avg(speed) AS v FROM li GROUP BY 1) JOIN
  (SELECT opp, first(hand ORDER BY n DESC, hand) AS h FROM (SELECT opp, hand, count(*) AS n FROM li GROUP BY 1, 2)
   GROUP BY 1) USING (opp) JOIN
  (SELECT opp, first(kind ORDER BY n DESC, kind) AS k FROM (SELECT opp, kind, count(*) AS n FROM li GROUP BY 1, 2)
   GROUP BY 1) USING (opp))"""


def profile(rows):
    return A.opponent_profile(rows, "opp", "speed", "hand", "kind", high=25.6, medium=25.4)


@query("a7_opponent_profile", "opp:l avg_velocity:f handedness:s primary_pitch:s velocity_tier:s",
       f"WITH {LI}, {PROFILE} SELECT * FROM prof")
def _(spark, sf):
    return profile(li(spark, sf))


PAIR_DAY = """pd AS (SELECT ent, opp, day, sum(att) AS pa, sum(hit) AS hr, sum(x) AS ev_sum, count(x) AS ev_n,
  sum(price) AS la_sum, count(price) AS la_n, count(*) AS rows FROM li GROUP BY 1, 2, 3)"""


def pair_days(spark, sf):
    return A.pair_day_agg(li(spark, sf), "ent", "opp", "day", "att", "hit", "x", "price")


@query("a8_pair_day_agg", "ent:l opp:l day:d pa:l hr:l ev:f la:g", f"""
WITH {LI}, {PAIR_DAY} SELECT ent, opp, day, pa, hr, ev_sum / ev_n AS ev, la_sum / la_n AS la FROM pd""")
def _(spark, sf):
    return pair_days(spark, sf).withColumns({"ev": F.col("ev_sum") / F.col("ev_n"), "la": F.col("la_sum") / F.col("la_n")})


@query("a9_pair_career_record", "ent:l opp:l career_pa:l career_hr:l career_avg_ev:f last_encounter_date:d "
       "encounters_last_year:l recent_pa:l recent_hr:l career_hr_rate:f recent_hr_rate:f familiarity_score:f", f"""
WITH {LI}, c AS (SELECT ent, opp, sum(att) AS career_pa, sum(hit) AS career_hr, avg(x) AS career_avg_ev,
  max(day) AS last_encounter_date, count(*) FILTER (day > DATE '2000-06-30' - 365) AS encounters_last_year
  FROM li GROUP BY 1, 2),
r AS (SELECT ent, opp, sum(att) AS recent_pa, sum(hit) AS recent_hr FROM (SELECT *, row_number() OVER (
  PARTITION BY ent, opp ORDER BY day DESC, l_orderkey DESC, inning DESC, l_partkey DESC, x DESC, price DESC) AS k FROM li)
  WHERE k <= 5 GROUP BY 1, 2)
SELECT *, CASE WHEN career_pa > 0 THEN career_hr / career_pa ELSE 0 END AS career_hr_rate,
  CASE WHEN recent_pa > 0 THEN recent_hr / recent_pa ELSE 0 END AS recent_hr_rate,
  least(career_pa / 20.0, 1.0) AS familiarity_score FROM c JOIN r USING (ent, opp)""")
def _(spark, sf):
    return A.pair_career_record(li(spark, sf), "ent", "opp", "day", ["l_orderkey", "inning", "l_partkey", "x", "price"],
                                "att", "hit", "x", "price", "2000-06-30")


SIMILAR = """sim AS (SELECT ent, group_type, group_value, sum(att) AS pa, sum(hit) AS hr FROM (
  SELECT ent, 'handedness' AS group_type, handedness AS group_value, att, hit FROM li JOIN prof USING (opp)
  UNION ALL SELECT ent, 'velocity', velocity_tier, att, hit FROM li JOIN prof USING (opp)) GROUP BY 1, 2, 3
  HAVING sum(att) > 0)"""


@query("a10_similarity_stats", "ent:l group_type:s group_value:s pa:l hr:l hr_rate:f",
       f"WITH {LI}, {PROFILE}, {SIMILAR} SELECT *, hr / pa AS hr_rate FROM sim")
def _(spark, sf):
    rows = li(spark, sf)
    return A.similarity_stats(rows, profile(rows), "ent", "opp", "att", "hit")


SIT = EV + """, sit AS (SELECT user_id, day, att AS is_pa, hit AS is_hr, CAST(floor(hr / 2) AS INTEGER) + 1 AS inning,
  CAST(angle AS INTEGER) % 9 - 4 AS diff, CASE WHEN event_type = 'click' THEN 1 END AS on1,
  CASE WHEN angle > 50 THEN 1 END AS on2, CASE WHEN angle > 80 THEN 1 END AS on3,
  CAST(angle AS INTEGER) % 4 AS balls, hr % 3 AS strikes, CAST(angle AS INTEGER) % 5 + 1 AS turn FROM ev)"""
BASES = ["on1", "on2", "on3"]


def sit(spark, sf):
    k = F.col("angle").cast("int")
    return ev(spark, sf).select(
        "user_id", "day", F.col("att").alias("is_pa"), F.col("hit").alias("is_hr"),
        (F.floor(F.col("hr") / 2).cast("int") + 1).alias("inning"), (k % 9 - 4).alias("diff"),
        F.when(F.col("event_type") == "click", 1).alias("on1"), F.when(F.col("angle") > 50, 1).alias("on2"),
        F.when(F.col("angle") > 80, 1).alias("on3"), (k % 4).alias("balls"), (F.col("hr") % 3).alias("strikes"),
        (k % 5 + 1).alias("turn"),
    )


def rates_sql(items: list[tuple[str, str, str, str]], as_of: bool = True, derived: str = "") -> str:
    """items: name, row condition or value, denominator condition, fallback (SQL over earlier names)."""
    parts = ", ".join(f"sum({t}) AS t_{n}, sum({b}) AS b_{n}" for n, t, b, _ in items)
    daily = f"dd AS (SELECT user_id, day, {parts} FROM sit GROUP BY 1, 2)"
    over = "OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" if as_of else ""
    sums = ", ".join(f"sum(t_{n}) {over} AS t_{n}, sum(b_{n}) {over} AS b_{n}" for n, *_ in items)
    tail = "FROM dd" if as_of else "FROM dd GROUP BY user_id"
    keys = "user_id, day" if as_of else "user_id"
    values = ", ".join(
        f"coalesce(CASE WHEN b_{n} <> 0 THEN t_{n} / CAST(b_{n} AS DOUBLE) END, {f}) AS {n}" for n, _, _, f in items)
    return f"WITH {SIT}, {daily}, ss AS (SELECT {keys}, {sums} {tail}), v AS (SELECT {keys}, {values} FROM ss) SELECT *{derived} FROM v"


def b(condition: str, value: str = "1") -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE 0 END"


PA = "is_pa = 1"
A11 = [
    ("avg_runners_on_base", b(PA, "coalesce(on1, 0) + coalesce(on2, 0) + coalesce(on3, 0)"), b(PA), "0"),
    ("risp_percentage", b(f"{PA} AND (on2 = 1 OR on3 = 1)"), b(PA), "0"),
    ("empty_bases_percentage", b(f"{PA} AND coalesce(on1, on2, on3) IS NULL"), b(PA), "1"),
    ("avg_score_differential", b(PA, "diff"), b(PA), "0"),
    ("trailing_percentage", b(f"{PA} AND diff < 0"), b(PA), "0.33"),
    ("leading_percentage", b(f"{PA} AND diff > 0"), b(PA), "0.33"),
    ("tied_percentage", b(f"{PA} AND diff = 0"), b(PA), "0.33"),
]
A11_SPEC = " ".join(f"{n}:f" for n, *_ in A11)


@query("a11_situation_stats", "user_id:l day:d " + A11_SPEC, rates_sql(A11))
def _(spark, sf):
    return A.entity_rates(sit(spark, sf), "user_id", "day", A.situation_rates(BASES, "diff"))


@query("a11_situation_stats_whole_history", "user_id:l " + A11_SPEC, rates_sql(A11, as_of=False))
def _(spark, sf):
    return A.entity_rates(sit(spark, sf), "user_id", "day", A.situation_rates(BASES, "diff"), as_of=False)


OVERALL = ("overall_hr_rate", b(PA, "is_hr"), b(PA), "0")


def share_and_rate(name: str, condition: str, suffix: str, share: str, rate: str):
    inside = b(f"{PA} AND {condition}")
    return [(f"{name}_{suffix}", f"nullif({inside}, 0)" if share != "0" else inside, b(PA), share),
            (f"{name}_hr_rate", b(f"{PA} AND {condition}", "is_hr"), inside, rate)]


A12 = [OVERALL, *share_and_rate("late_inning", "inning >= 7", "pa_percentage", "0", "0"),
       *share_and_rate("close_game", "abs(diff) <= 2", "pa_percentage", "0.5", "overall_hr_rate"),
       *share_and_rate("clutch", "inning >= 7 AND abs(diff) <= 3 AND coalesce(on1, on2, on3) IS NOT NULL",
                       "pa_percentage", "0.2", "overall_hr_rate")]


@query("a12_pressure_stats", "user_id:l day:d " + " ".join(f"{n}:f" for n, *_ in A12) + " pressure_performance_index:f",
       rates_sql(A12, derived=", CASE WHEN overall_hr_rate > 0 THEN clutch_hr_rate / overall_hr_rate ELSE 1 END "
                              "AS pressure_performance_index"))
def _(spark, sf):
    return A.entity_rates(sit(spark, sf), "user_id", "day", A.pressure_rates("inning", "diff", BASES),
                          derived={n: f() for n, f in A.PRESSURE_INDEX.items()})


A13 = [(n, b(f"{PA} AND {c}", "is_hr"), b(f"{PA} AND {c}"), "0") for n, c in [
    ("first_inning_hr_rate", "inning = 1"), ("middle_innings_hr_rate", "inning BETWEEN 3 AND 6"),
    ("late_innings_hr_rate", "inning BETWEEN 7 AND 9"), ("extra_innings_hr_rate", "inning >= 10"),
    ("first_pa_hr_rate", "turn = 1"), ("leadoff_inning_hr_rate", "turn = 1")]]


@query("a13_inning_stats", "user_id:l day:d " + " ".join(f"{n}:f" for n, *_ in A13), rates_sql(A13))
def _(spark, sf):
    return A.entity_rates(sit(spark, sf), "user_id", "day", A.inning_rates("inning", "turn"))


SCORE = ("(CASE WHEN inning >= 7 THEN 2 ELSE 0 END + CASE WHEN inning >= 9 THEN 1 ELSE 0 END + CASE WHEN abs(diff) <= 1 "
         "THEN 2 ELSE 0 END + CASE WHEN abs(diff) <= 3 THEN 1 ELSE 0 END + CASE WHEN coalesce(on2, on3) IS NOT NULL "
         "THEN 1 ELSE 0 END)")
A14 = [OVERALL, *share_and_rate("high_leverage", f"{SCORE} >= 4", "pa_pct", "0.2", "overall_hr_rate"),
       *share_and_rate("medium_leverage", f"{SCORE} BETWEEN 2 AND 3", "pa_pct", "0.6", "overall_hr_rate"),
       *share_and_rate("low_leverage", f"{SCORE} <= 1", "pa_pct", "0.2", "overall_hr_rate")]


@query("a14_leverage_stats", "user_id:l day:d " + " ".join(f"{n}:f" for n, *_ in A14) + " leverage_performance_ratio:f",
       rates_sql(A14, derived=", CASE WHEN low_leverage_hr_rate > 0 THEN high_leverage_hr_rate / low_leverage_hr_rate "
                              "ELSE 1 END AS leverage_performance_ratio"))
def _(spark, sf):
    rows = sit(spark, sf).withColumn("score", A.leverage_score("inning", "diff", BASES))
    return A.entity_rates(rows, "user_id", "day", A.leverage_rates("score"),
                          derived={n: f() for n, f in A.LEVERAGE_RATIO.items()})


AHEAD = "((balls = 2 AND strikes = 0) OR (balls = 3 AND strikes = 1) OR (balls = 3 AND strikes = 0))"
BEHIND = "((balls = 0 AND strikes = 2) OR (balls = 1 AND strikes = 2))"
A15 = [*[(n, b(c, "is_hr"), b(c), "0") for n, c in [
    ("hitters_count_hr_rate", AHEAD), ("pitchers_count_hr_rate", BEHIND),
    ("even_count_hr_rate", "balls = strikes"), ("two_strike_hr_rate", "strikes = 2")]],
    ("ahead_in_count_pct", b(AHEAD), "1", "0"), ("behind_in_count_pct", b(BEHIND), "1", "0")]


@query("a15_count_stats", "user_id:l day:d " + " ".join(f"{n}:f" for n, *_ in A15), rates_sql(A15))
def _(spark, sf):
    return A.entity_rates(sit(spark, sf), "user_id", "day", A.count_rates("balls", "strikes"))


@query("a16_group_rate_having", "park:l hr_rate:f games:l", f"""
WITH {LI} SELECT park, avg(hit) AS hr_rate, count(*) AS games FROM li GROUP BY 1 HAVING count(*) >= 50""")
def _(spark, sf):
    return A.group_rate_having(li(spark, sf), "park", "hit", 50)


@query("a16_hourly_rate", "hr:i hr_rate:f games:l", f"""
WITH {EV} SELECT hr, avg(hit) AS hr_rate, count(*) AS games FROM ev GROUP BY 1 HAVING count(*) > 10""")
def _(spark, sf):
    return A.group_rate_having(ev(spark, sf), "hr", "hit", 10, strict=True)


DIMS = """dims AS (SELECT n_nationkey AS park, n_name AS stadium, 310.0 + n_nationkey AS lf_dist, 400.0 + n_regionkey * 5 AS cf_dist,
  305.0 + n_nationkey * 2 AS rf_dist, 6.0 + n_regionkey * 4 AS lf_wall, 8.0 + n_regionkey AS cf_wall,
  CASE WHEN n_nationkey % 3 = 0 THEN 12.0 ELSE 5.0 END AS rf_wall,
  CASE n_nationkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS foul,
  n_nationkey * 220.0 AS elevation, 25.0 + n_nationkey AS latitude, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS dome,
  CASE WHEN n_nationkey % 7 = 0 THEN 'turf' ELSE 'grass' END AS surface FROM nation)"""


def park_dims(spark, sf):
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, sf, "nation").select(
        k.alias("park"), F.col("n_name").alias("stadium"), (310.0 + k).alias("lf_dist"), (400.0 + r * 5).alias("cf_dist"),
        (305.0 + k * 2).alias("rf_dist"), (6.0 + r * 4).alias("lf_wall"), (8.0 + r).alias("cf_wall"),
        F.when(k % 3 == 0, 12.0).otherwise(5.0).alias("rf_wall"),
        F.when(k % 3 == 0, "small").when(k % 3 == 1, "medium").otherwise("large").alias("foul"),
        (k * 220.0).alias("elevation"), (25.0 + k).alias("latitude"), F.when(k % 5 == 0, 1).otherwise(0).alias("dome"),
        F.when(k % 7 == 0, "turf").otherwise("grass").alias("surface"))


@query("a17_park_effects", "park:l hr_rate:f games:l avg_distance:f elevation:f dome:i", f"""
WITH {LI}, {DIMS} SELECT park, avg(hit) AS hr_rate, count(*) AS games,
  first((lf_dist + cf_dist + rf_dist) / 3) AS avg_distance, first(elevation) AS elevation, first(dome) AS dome
FROM li JOIN dims USING (park) GROUP BY 1 HAVING count(*) >= 10""")
def _(spark, sf):
    return A.park_effects(li(spark, sf), "park", "hit", park_dims(spark, sf))


def lift_sql(frame_in: str, frame_out: str) -> str:
    return f"""WITH {LI}, g AS (SELECT ent, opp, day, sum(hit) AS h, count(*) AS n FROM li GROUP BY 1, 2, 3),
s AS (SELECT ent, opp, day, sum(h) OVER (PARTITION BY ent, opp {frame_in}) AS gh,
  coalesce(sum(n) OVER (PARTITION BY ent, opp {frame_in}), 0) AS gn, sum(h) OVER (PARTITION BY ent {frame_out}) AS eh,
  sum(n) OVER (PARTITION BY ent {frame_out}) AS en FROM g)
SELECT ent, opp, day, coalesce(CASE WHEN eh / en > 0 THEN (gh / nullif(gn, 0) - eh / en) / (eh / en) END, 0) AS rate_boost,
  least(gn / 20.0, 1.0) AS comfort_factor FROM s"""


@query("a18_entity_group_lift", "ent:l opp:l day:d rate_boost:f comfort_factor:f",
       lift_sql("ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING",
                "ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING"))
def _(spark, sf):
    return A.entity_group_lift(li(spark, sf), "ent", "opp", "day", "hit")


@query("a18_entity_group_lift_whole_history", "ent:l opp:l day:d rate_boost:f comfort_factor:f", lift_sql("", ""))
def _(spark, sf):
    return A.entity_group_lift(li(spark, sf), "ent", "opp", "day", "hit", as_of=False)


@query("a28_table_stats", "table_name:s rows:l keys:l first_date:d last_date:d", """
SELECT 'events' AS table_name, count(*) AS rows, count(DISTINCT user_id) AS keys, min(CAST(ts AS DATE)) AS first_date,
  max(CAST(ts AS DATE)) AS last_date FROM events
UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey), min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))
  FROM orders
UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_suppkey), min(CAST(l_shipdate AS DATE)),
  max(CAST(l_shipdate AS DATE)) FROM lineitem""")
def _(spark, sf):
    rows = [("events", "user_id", "ts"), ("orders", "o_custkey", "o_orderdate"), ("lineitem", "l_suppkey", "l_shipdate")]
    parts = [A.table_stats(table(spark, sf, t).select(k, F.to_date(d).alias("d")), {"keys": k}, "d", t) for t, k, d in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a30_entity_recent_form", "ent:l games:l avg_x:f hits:l attempts:l hr_rate:f", f"""
WITH {LI} SELECT ent, count(*) AS games, avg(x) AS avg_x, sum(hit) AS hits, sum(att) AS attempts,
  sum(hit) / greatest(sum(att), 1) AS hr_rate FROM li WHERE day >= (SELECT max(day) FROM li) - 60 GROUP BY 1""")
def _(spark, sf):
    return A.entity_recent_form(li(spark, sf), "ent", "day", 60, "hit", "att", ["x"])
