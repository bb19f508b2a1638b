"""B family, A19-A21 and A29 on orders read as a betting market."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.bindings.frames import BOARD, odds_board
from fairline.bindings.registry import query
from fairline.operators import market as B

PAY = "CASE WHEN odds_yes >= 0 THEN odds_yes / 100 ELSE 100 / -odds_yes END"
PRICED = BOARD + f""", pr AS (SELECT *, CASE WHEN odds_yes >= 0 THEN 100 / (odds_yes + 100) ELSE -odds_yes / (100 - odds_yes) END AS pi,
  -odds_no / (100 - odds_no) AS qi, least(greatest(p, 0.000001), 0.999999) AS pc, {PAY} AS b FROM board),
px AS (SELECT *, pi AS implied_probability, pi / (pi + qi) AS no_vig_probability, CASE WHEN pc >= 0.5 THEN -round_even(pc / (1 - pc) * 100, 0)
  ELSE round_even((1 - pc) / pc * 100, 0) END AS fair_odds, pc * b - (1 - pc) AS expected_value,
  CASE WHEN b IS NOT NULL THEN least(greatest((b * pc - (1 - pc)) / b, 0), 1) END AS kelly_fraction FROM pr)"""


def priced(spark, sf):
    return B.price_market(odds_board(spark, sf), "p", "odds_yes", "odds_no")


@query("b1_price_market", "offer:l implied_probability:f no_vig_probability:f fair_odds:f expected_value:f kelly_fraction:f", f"WITH {PRICED} SELECT * FROM px")
def _(spark, sf):
    return priced(spark, sf)


@query("b2_odds_gap", "offer:l need_ev0:f gap_ev0:f need_ev5:f gap_ev5:f", f"""
WITH {PRICED} SELECT offer, fair_odds AS need_ev0, fair_odds - odds_yes AS gap_ev0, fair_odds + 5 AS need_ev5, fair_odds + 5 - odds_yes AS gap_ev5 FROM px""")
def _(spark, sf):
    return B.odds_gap(B.odds_gap(priced(spark, sf), "p", "odds_yes"), "p", "odds_yes", 0.05)


SCORE = """least(greatest(least(expected_value * 10, 5) + CASE WHEN p BETWEEN 0.08 AND 0.2 THEN 2 ELSE 0 END + CASE WHEN total / 3000000 > 0.1 THEN 1 ELSE 0 END
  + CASE WHEN 1 + player % 10 / 100.0 > 1.05 THEN 1 ELSE 0 END - CASE WHEN kelly_fraction > 0.15 THEN 1 ELSE 0 END, 0), 10)"""
OPPS = PRICED + f""", op AS (SELECT *, {SCORE} AS confidence_score, least(kelly_fraction, 0.25) AS kelly_capped FROM px
  WHERE odds_yes IS NOT NULL AND p >= 0.06 AND expected_value >= 0.05)"""


def scored(spark, sf):
    return priced(spark, sf).withColumns({"roll10_hr_rate": F.col("total") / 3000000, "park_factor": 1 + F.col("player") % 10 / 100.0})


@query("b3_confidence_score", "offer:l confidence_score:f", f"WITH {PRICED} SELECT offer, {SCORE} AS confidence_score FROM px WHERE odds_yes IS NOT NULL")
def _(spark, sf):
    rows = scored(spark, sf).where("odds_yes IS NOT NULL")
    return rows.withColumn("confidence_score", B.confidence_score(rows, "p"))


@query("b4_find_opportunities", "offer:l expected_value:f kelly_fraction:f confidence_score:f", f"""
WITH {OPPS} SELECT offer, expected_value, kelly_capped AS kelly_fraction, confidence_score FROM op WHERE confidence_score >= 5""")
def _(spark, sf):
    return B.find_opportunities(scored(spark, sf), "p", "odds_yes", min_confidence=5.0)


@query("b5_simple_opportunities", "offer:l ev:f", f"""
WITH {PRICED} SELECT offer, p * (1 + odds_yes / 100) - 1 AS ev FROM px WHERE p > 0 AND odds_yes > 0 AND p * (1 + odds_yes / 100) - 1 > 0.05""")
def _(spark, sf):
    return B.simple_opportunities(odds_board(spark, sf), "p", "odds_yes")


@query("b6_near_misses", "offer:l gap_ev0:f gap_ev2:f gap_ev5:f need_ev0:f need_ev2:f need_ev5:f", f"""
WITH {PRICED} SELECT offer, fair_odds - odds_yes AS gap_ev0, fair_odds + 2 - odds_yes AS gap_ev2, fair_odds + 5 - odds_yes AS gap_ev5, fair_odds AS need_ev0,
  fair_odds + 2 AS need_ev2, fair_odds + 5 AS need_ev5 FROM px WHERE odds_yes IS NOT NULL AND p >= 0.06 AND expected_value < 0.05 ORDER BY gap_ev0, offer LIMIT 15""")
def _(spark, sf):
    return B.near_misses(priced(spark, sf), "p", "odds_yes", "offer")


SIZED = f"""s AS (SELECT *, least(kelly_capped * 1000, 50) AS wanted, coalesce(sum(least(kelly_capped * 1000, 50)) OVER (PARTITION BY date
  ORDER BY expected_value DESC, offer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM op)"""


@query("b7_size_bets_greedy_cap", "offer:l date:d recommended_bet:f expected_profit:f", f"""
WITH {OPPS}, {SIZED} SELECT offer, date, greatest(0, least(wanted, 100 - spent)) AS recommended_bet, expected_value * greatest(0, least(wanted, 100 - spent)) AS expected_profit
FROM s WHERE spent < 100""")
def _(spark, sf):
    return B.size_bets_greedy_cap(B.find_opportunities(scored(spark, sf), "p", "odds_yes"), "date", "offer")


LEDGER = PRICED + """, lg AS (SELECT offer AS bet_id, date, p AS model_probability, odds_yes AS odds, CAST(10 + offer % 90 AS DOUBLE) AS bet_amount,
  expected_value, CAST(offer % 10 AS DOUBLE) AS confidence_score, status AS st, bookmaker, b FROM px WHERE odds_yes IS NOT NULL),
st AS (SELECT *, CASE st WHEN 'P' THEN 'pending' WHEN 'F' THEN 'won' ELSE 'lost' END AS status, CASE WHEN st = 'F' THEN CASE WHEN bet_id % 13 = 0 THEN 42.0 ELSE
  bet_amount * b END WHEN st = 'O' THEN -bet_amount END AS profit_loss, CASE WHEN st = 'F' THEN CASE WHEN bet_id % 13 = 0 THEN 42.0 ELSE bet_amount * b END
  WHEN st = 'O' THEN 0 END AS payout, CASE st WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS actual_result FROM lg)"""


def settled(spark, sf):
    rows = priced(spark, sf).where("odds_yes IS NOT NULL")
    bets = rows.select(F.col("offer").alias("bet_id"), "date", F.col("p").alias("model_probability"), F.col("odds_yes").alias("odds"),
                       (10.0 + F.col("offer") % 90).alias("bet_amount"), "expected_value", (F.col("offer") % 10).cast("double").alias("confidence_score"))
    results = rows.where("status <> 'P'").select(F.col("offer").alias("bet_id"), (F.col("status") == "F").alias("won"),
                                                 F.when(F.col("offer") % 13 == 0, 42.0).alias("actual_payout"))
    return B.settle_bets(bets, results)


@query("b8_settle_bets", "bet_id:l status:s actual_result:i payout:f profit_loss:f", f"WITH {LEDGER} SELECT * FROM st")
def _(spark, sf):
    return settled(spark, sf)


@query("b9_accept_within_limit", "offer:l date:d accepted:i", """
WITH RECURSIVE t AS (SELECT o_orderkey AS offer, CAST(o_orderdate AS DATE) AS date, o_totalprice / 100 AS stake,
  row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS r FROM orders),
x AS (SELECT offer, date, r, CASE WHEN stake <= 6000 THEN 1 ELSE 0 END AS accepted, CASE WHEN stake <= 6000 THEN stake ELSE 0 END AS used FROM t WHERE r = 1
  UNION ALL SELECT t.offer, t.date, t.r, CASE WHEN used + stake <= 6000 THEN 1 ELSE 0 END, CASE WHEN used + stake <= 6000 THEN used + stake ELSE used END
  FROM x JOIN t ON t.date = x.date AND t.r = x.r + 1) SELECT offer, date, accepted FROM x""")
def _(spark, sf):
    bets = odds_board(spark, sf).select("offer", "date", (F.col("total") / 100).alias("stake"))
    return B.accept_within_limit(bets, "date", ["offer"], "offer", "stake", 6000.0)


@query("b10_propose_daily_stakes", "offer:l bet_amount:f bet_id:s", f"""
WITH {OPPS} SELECT offer, least(kelly_capped * 500, 50) AS bet_amount, strftime(date, '%Y-%m-%d') || '_Player_' || player || '_' || right('00000000' || offer, 8) AS bet_id
FROM op WHERE confidence_score >= 6 AND least(kelly_capped * 500, 50) >= 5""")
def _(spark, sf):
    rows = B.find_opportunities(scored(spark, sf), "p", "odds_yes").withColumns({
        "name": F.concat(F.lit("Player "), "player"), "stamp": F.lpad(F.col("offer").cast("string"), 12, "0")})
    return B.propose_daily_stakes(rows, "date", "name", "stamp")


@query("b11_calibrate_percentile", "offer:l calibrated:f plain:f", f"""
WITH {BOARD}, v AS (SELECT offer, round(p, 3) AS q FROM board), r AS (SELECT offer, (rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0) / count(*) OVER () AS s FROM v)
SELECT offer, CASE WHEN s <= 0.5 THEN 0.05 + s * 100 * 0.07 / 50 WHEN s <= 0.75 THEN 0.12 + (s * 100 - 50) * 0.06 / 25 WHEN s <= 0.9 THEN 0.18 + (s * 100 - 75) * 0.07 / 15
  WHEN s <= 0.95 THEN 0.25 + (s * 100 - 90) * 0.05 / 5 WHEN s <= 0.99 THEN 0.3 + (s * 100 - 95) * 0.05 / 4 ELSE 0.35 END AS calibrated, 0.05 + 0.25 * s AS plain FROM r""")
def _(spark, sf):
    rows = odds_board(spark, sf).select("offer", F.round("p", 3).alias("q"))
    plain = B.calibrate_percentile(rows, "q", points=None).withColumnRenamed("calibrated", "plain")
    return B.calibrate_percentile(plain, "q")


@query("b11_calibrate_percentile_per_day", "offer:l calibrated:f", f"""
WITH {BOARD}, r AS (SELECT offer, (rank() OVER (PARTITION BY date ORDER BY p) + (count(*) OVER (PARTITION BY date, p) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS s FROM board)
SELECT offer, 0.05 + 0.25 * s AS calibrated FROM r""")
def _(spark, sf):
    return B.calibrate_percentile(odds_board(spark, sf).select("offer", "date", "p"), "p", ["date"], points=None)


@query("b12_calibrate_logit", "offer:l calibrated:f scaled:f", f"""
WITH {BOARD} SELECT offer, 1 / (1 + exp(-(0.1 * ln(p / (1 - p)) - 3.5))) AS calibrated, p * 0.8 AS scaled FROM board""")
def _(spark, sf):
    return odds_board(spark, sf).select("offer", B.calibrate_logit(F.col("p")).alias("calibrated"), B.scale_factor(F.col("p"), 0.8).alias("scaled"))


@query("a19_best_offer_per_key", "player:l bookmaker:s odds_yes:f odds_no:f no_vig_probability:f", f"""
WITH {PRICED}, r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY odds_yes DESC, bookmaker, odds_no) AS k FROM px WHERE odds_yes IS NOT NULL)
SELECT player, bookmaker, odds_yes, odds_no, no_vig_probability FROM r WHERE k = 1""")
def _(spark, sf):
    quotes = odds_board(spark, sf).groupBy("player", "bookmaker", "odds_yes").agg(F.min("odds_no").alias("odds_no"))
    return B.best_offer_per_key(quotes, ["player"], "bookmaker", "odds_yes", "odds_no")


@query("a20_ledger_summary", "date:d total_bets:l settled_bets:l wins:l losses:l total_wagered:f total_profit_loss:f avg_model_probability:f avg_expected_value:f "
       "avg_confidence_score:f win_rate:f roi:f actual_ev_per_bet:f", f"""
WITH {LEDGER}, g AS (SELECT date, count(*) AS total_bets, count(*) FILTER (status <> 'pending') AS settled_bets, count(*) FILTER (status = 'won') AS wins,
  count(*) FILTER (status = 'lost') AS losses, sum(bet_amount) AS total_wagered, coalesce(sum(profit_loss), 0) AS total_profit_loss, avg(model_probability) AS avg_model_probability,
  avg(expected_value) AS avg_expected_value, avg(confidence_score) AS avg_confidence_score FROM st WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY GROUPING SETS ((date), ()))
SELECT *, coalesce(wins / nullif(settled_bets, 0), 0) AS win_rate, coalesce(total_profit_loss / nullif(total_wagered, 0), 0) AS roi,
  coalesce(total_profit_loss / nullif(settled_bets, 0), 0) AS actual_ev_per_bet FROM g""")
def _(spark, sf):
    return B.ledger_summary(settled(spark, sf), first="1996-01-01", last="1999-12-31")


@query("a21_daily_exposure", "date:d daily_risk:f", f"WITH {LEDGER} SELECT date, sum(bet_amount) AS daily_risk FROM st GROUP BY 1")
def _(spark, sf):
    return B.daily_exposure(settled(spark, sf))


@query("a29_opportunity_summary", "total_players_with_odds:l total_opportunities:l opportunity_rate:f avg_model_probability:f avg_expected_value:f positive_ev_count:l "
       "best_ev:f avg_opportunity_ev:f total_kelly_allocation:f avg_confidence:f", f"""
WITH {OPPS}, a AS (SELECT count(*) AS total_players_with_odds, avg(p) AS avg_model_probability, avg(expected_value) AS avg_expected_value,
  count(*) FILTER (expected_value > 0) AS positive_ev_count FROM px WHERE odds_yes IS NOT NULL), b AS (SELECT count(*) AS total_opportunities, max(expected_value) AS best_ev,
  avg(expected_value) AS avg_opportunity_ev, sum(kelly_capped) AS total_kelly_allocation, avg(confidence_score) AS avg_confidence FROM op)
SELECT *, total_opportunities / total_players_with_odds AS opportunity_rate FROM a, b""")
def _(spark, sf):
    rows = scored(spark, sf)
    return B.opportunity_summary(rows, B.find_opportunities(rows, "p", "odds_yes"), "p", "odds_yes")
