"""Market pricing, ranking, sizing and the bet ledger (B family, A19-A21, A29)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.columns import clip, first_matching
from fairline.functions.durable import materialise
from fairline.functions.ordering import average_rank, running_totals

SURE = 1e-6


def implied_probability(odds: Column) -> Column:
    """Win probability an American price stands for."""
    return F.when(odds >= 0, 100 / (odds + 100)).otherwise(-odds / (-odds + 100))


def payout_multiplier(odds: Column) -> Column:
    """Profit per unit staked."""
    return F.when(odds >= 0, odds / 100).otherwise(F.lit(100.0) / F.abs(odds))


def bounded(p: Column) -> Column:
    return clip(p, SURE, 1 - SURE)


def fair_odds(p: Column) -> Column:
    """Break-even American price, rounded half to even."""
    q = bounded(p)
    return F.when(q >= 0.5, -F.rint(q / (1 - q) * 100)).otherwise(F.rint((1 - q) / q * 100))


def decimal_to_american(price: Column) -> Column:
    return F.when(price >= 2.0, F.rint((price - 1) * 100)).otherwise(F.rint(F.lit(-100.0) / (price - 1)))


def no_vig_probability(yes: Column, no: Column) -> Column:
    """Implied probability of the first side with the bookmaker's margin removed."""
    p, q = implied_probability(yes), implied_probability(no)
    return F.when(p + q > 0, p / (p + q))


def expected_value(p: Column, odds: Column) -> Column:
    return bounded(p) * payout_multiplier(odds) - (1 - bounded(p))


def kelly_fraction(p: Column, odds: Column) -> Column:
    b, q = payout_multiplier(odds), bounded(p)
    return F.when(b == 0, F.lit(0.0)).otherwise(clip((b * q - (1 - q)) / F.nullif(b, F.lit(0.0)), 0.0, 1.0))


def price_market(df: DataFrame, p: str, yes: str, no: str | None = None) -> DataFrame:
    """B1: implied and fair values, EV and Kelly of every quote; a missing quote leaves them null."""
    out = {
        "implied_probability": implied_probability(F.col(yes)), "fair_odds": fair_odds(F.col(p)),
        "expected_value": expected_value(F.col(p), F.col(yes)), "kelly_fraction": kelly_fraction(F.col(p), F.col(yes)),
    }
    if no:
        out["no_vig_probability"] = no_vig_probability(F.col(yes), F.col(no))
    return df.withColumns(out)


def odds_gap(df: DataFrame, p: str, odds: str, target_ev: float = 0.0) -> DataFrame:
    """B2: price needed for a target EV (linear adjustment) and its distance from the quote."""
    tag, needed = int(round(target_ev * 100)), fair_odds(F.col(p)) + 100 * target_ev
    return df.withColumns({f"need_ev{tag}": needed, f"gap_ev{tag}": needed - F.col(odds)})


def confidence_score(df: DataFrame, p: str, ev: str = "expected_value", kelly: str = "kelly_fraction") -> Column:
    """0-10 score from EV, probability range, recent rate, park and stake size."""
    score = F.least(F.col(ev) * 10, F.lit(5.0)) + F.when(F.col(p).between(0.08, 0.20), 2.0).otherwise(0.0)
    if "roll10_hr_rate" in df.columns:
        score = score + F.when(F.col("roll10_hr_rate") > 0.10, 1.0).otherwise(0.0)
    if "park_factor" in df.columns:
        score = score + F.when(F.col("park_factor") > 1.05, 1.0).otherwise(0.0)
    score = score - F.when(F.col(kelly) > 0.15, 1.0).otherwise(0.0)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(10.0))


def find_opportunities(
    priced: DataFrame, p: str, odds: str, min_ev: float = 0.05, min_probability: float = 0.06,
    min_confidence: float = 0.0, max_kelly: float = 0.25,
) -> DataFrame:
    """Quoted rows above the limits with confidence and capped Kelly; order them where they are read."""
    kept = priced.where(
        F.col(odds).isNotNull() & (F.col(p) >= min_probability) & (F.col("expected_value") >= min_ev))
    scored = kept.withColumn("confidence_score", confidence_score(kept, p))
    limited = scored.withColumn("kelly_fraction", F.least(F.col("kelly_fraction"), F.lit(max_kelly)))
    return limited.where(F.col("confidence_score") >= min_confidence) if min_confidence > 0 else limited


def simple_opportunities(df: DataFrame, p: str, odds: str, min_ev: float = 0.05) -> DataFrame:
    """Positive probability and price, EV from the decimal price."""
    price = payout_multiplier(F.col(odds)) + 1
    return df.where((F.col(p) > 0) & (F.col(odds) > 0)).withColumn("ev", F.col(p) * price - 1).where(F.col("ev") > min_ev)


def near_misses(
    priced: DataFrame, p: str, odds: str, key: str, min_ev: float = 0.05, min_probability: float = 0.06,
    targets: tuple[float, ...] = (0.0, 0.02, 0.05), top: int = 15,
) -> DataFrame:
    """Quotes just below the EV limit, smallest gap to break-even first."""
    rows = priced.where(F.col(odds).isNotNull() & (F.col(p) >= min_probability) & (F.col("expected_value") < min_ev))
    for target in targets:
        rows = odds_gap(rows, p, odds, target)
    return rows.orderBy("gap_ev0", key).limit(top)


def size_bets_greedy_cap(
    opportunities: DataFrame, day: str, key: str, bankroll: float = 1000.0, single: float = 0.05, daily: float = 0.10,
) -> DataFrame:
    """Per day in EV order, Kelly stakes limited per bet, the last one cut at the daily limit, none after it.

    The running stake comes from range slices, so a day with very many quotes
    is not sorted in one task.
    """
    wanted = F.least(F.col("kelly_fraction") * bankroll, F.lit(single * bankroll))
    rows = opportunities.withColumns({"kelly_bet": F.col("kelly_fraction") * bankroll, "wanted": wanted})
    ranked = running_totals(rows, [day], [F.desc("expected_value"), F.asc(key)], ["wanted"])
    cap = F.lit(daily * bankroll)
    stake = F.greatest(F.lit(0.0), F.least(F.col("wanted"), cap - F.col("wanted_before")))
    return ranked.where(F.col("wanted_before") < cap).withColumn("recommended_bet", stake).withColumn(
        "expected_profit", F.col("recommended_bet") * F.col("expected_value")).drop("wanted", "wanted_before")


def settle_bets(bets: DataFrame, results: DataFrame, key: str = "bet_id") -> DataFrame:
    """Profit of won bets (given payout first, else from the odds), loss of the stake, new status."""
    joined = bets.join(results.select(key, F.col("won").alias("_won"), F.col("actual_payout").alias("_paid")), key, "left")
    profit = F.coalesce(F.col("_paid"), F.col("bet_amount") * payout_multiplier(F.col("odds")))
    known = F.col("_won").isNotNull()
    payout = F.when(F.col("_won"), profit).otherwise(F.lit(0.0))
    return joined.withColumns({
        "status": F.when(known, F.when(F.col("_won"), "won").otherwise("lost")).otherwise(F.lit("pending")),
        "actual_result": F.col("_won").cast("int"), "payout": F.when(known, payout),
        "profit_loss": F.when(known, F.when(F.col("_won"), profit).otherwise(-F.col("bet_amount"))),
    }).drop("_won", "_paid")


#: Type of money totals.
EXACT = "decimal(30,6)"


def _folded(bets: DataFrame, day: str, order: list[str], key: str, stake: str, limit: Column) -> DataFrame:
    """First-fit over one short, ordered array per day: ``total`` and the keys ``taken``."""
    listed = bets.groupBy(day).agg(
        F.first("_used").alias("_used"),
        F.sort_array(F.collect_list(F.struct(*order, F.col(key).alias("_key"), F.col(stake).alias("_stake")))).alias("_bets"))

    def step(s, x):
        fits = s["total"] + x["_stake"] <= limit
        return F.struct(
            F.when(fits, (s["total"] + x["_stake"]).cast(EXACT)).otherwise(s["total"]).alias("total"),
            F.when(fits, F.concat(s["taken"], F.array(x["_key"]))).otherwise(s["taken"]).alias("taken"))

    kind = bets.schema[key].dataType.simpleString()
    start = F.struct(F.col("_used").alias("total"), F.array().cast(f"array<{kind}>").alias("taken"))
    return listed.select(day, F.aggregate("_bets", start, step).alias("_end")).select(day, "_end.*")


def _first_bets(
    pending: DataFrame, day: str, order: list[str], key: str, stake: str, most: Column, spot: Column, fold_rows: int,
) -> tuple[DataFrame, DataFrame]:
    """Accepted ones of each day's first ``fold_rows`` bets (and ties), and the later bets that may still fit."""
    first = Window.partitionBy(day).orderBy(*dict.fromkeys([*[c for c in order if c != day], key]))
    head = materialise(pending.withColumn("_rank", F.rank().over(first)).where(F.col("_rank") <= fold_rows).drop("_rank"))
    folded = materialise(_folded(head, day, order, key, stake, most))
    ends = head.groupBy(day).agg(F.max(spot).alias("_last")).join(folded.select(day, F.col("total").cast(EXACT).alias("_now")), day)
    later = pending.join(ends, day).where((spot > F.col("_last")) & (F.col(stake) <= most - F.col("_now")))
    return folded.select(day, F.explode("taken").alias(key)), materialise(later.withColumn("_used", F.col("_now")).drop("_last", "_now"))


def accept_within_limit(
    bets: DataFrame, day: str, order: list[str], key: str, stake: str, limit: float, fold_rows: int = 1000,
    used: DataFrame | None = None,
) -> DataFrame:
    """A bet is accepted iff the day's accepted total plus its stake stays within the limit.

    Totals are exact decimals (six places), so how they are grouped doesn't matter. Let ``r`` be what a day has left. Bets
    of at most ``r / 2`` all fit as long as those before them sum to no more than ``r / 2``; of the larger ones the first
    that fits beside them is found by its running total. A distributed pass accepts up to whichever comes first, the
    crossing or the larger bet: then less than half of ``r`` is left. So passes grow with the logarithm of the limit over
    the smallest stake, whatever the order of tiny and large bets; bets larger than what is left go out in each. Days of
    at most ``fold_rows`` open bets finish with a fold, which gives the very same choice. ``used`` (``day``, ``used``)
    tells what earlier bets of a day have taken.

    Every pass begins with a fold of each day's first ``fold_rows`` open bets. Where stakes aren't tiny that already
    fills the day, and the distributed pass sees only the bets that fit in the little that is left.
    """
    keys = [day, *[c for c in order if c != day], key, stake]
    most = F.lit(limit).cast(EXACT)
    pending = bets.select(*dict.fromkeys(keys)).withColumn(stake, F.col(stake).cast(EXACT))
    if used is None:
        pending = pending.withColumn("_used", F.lit(0).cast(EXACT))
    else:
        pending = pending.join(used.select(day, F.col("used").cast(EXACT).alias("_used")), day, "left")
        pending = pending.withColumn("_used", F.coalesce("_used", F.lit(0).cast(EXACT)))
    pending = pending.where(F.col(stake) <= most - F.col("_used"))
    taken = []
    spot = F.struct(*dict.fromkeys([*[c for c in order if c != day], key]))
    pending = materialise(pending)

    def longest() -> int:
        return pending.groupBy(day).count().agg(F.max("count")).first()[0] or 0

    while longest() > fold_rows:
        head, pending = _first_bets(pending, day, order, key, stake, most, spot, fold_rows)
        taken.append(head)
        if longest() <= fold_rows:
            break
        left = most - F.col("_used")
        small = F.col(stake) * 2 <= left
        summed = materialise(running_totals(
            pending.withColumn("_small", F.when(small, F.col(stake)).otherwise(F.lit(0)).cast(EXACT)), [day], [*order, key], ["_small"]))
        before = F.col("_small_before")
        crossed = small & (before * 2 > left)
        large = ~small & (F.col(stake) + before <= left) & (before * 2 <= left)
        stops = summed.groupBy(day).agg(F.min(F.when(crossed | large, spot)).alias("_stop"))
        placed = materialise(summed.join(stops, day).withColumns({
            "_ahead": F.coalesce(spot < F.col("_stop"), F.lit(True)), "_here": F.coalesce(spot == F.col("_stop"), F.lit(False))}))
        wins = (small & F.col("_ahead")) | (large & F.col("_here"))
        taken.append(placed.where(wins).select(day, key))
        now = placed.groupBy(day).agg((F.first("_used") + F.sum(F.when(wins, F.col(stake)).otherwise(F.lit(0).cast(EXACT)))).cast(EXACT).alias("_now"))
        rest = placed.where(~F.col("_ahead") & ~(large & F.col("_here"))).join(now, day).where(F.col(stake) <= most - F.col("_now"))
        pending = materialise(rest.select(*dict.fromkeys(keys), F.col("_now").alias("_used")))
    accepted = _folded(pending, day, order, key, stake, most).select(day, F.explode("taken").alias(key))
    for more in taken:
        accepted = accepted.unionByName(more)
    return bets.join(accepted.withColumn("accepted", F.lit(1)), [day, key], "left").withColumn(
        "accepted", F.coalesce("accepted", F.lit(0)))


def propose_daily_stakes(
    opportunities: DataFrame, day: str, player: str, stamp: str, bankroll: float = 1000.0, min_confidence: float = 6.0,
    share: float = 0.5, highest: float = 50.0, lowest: float = 5.0,
) -> DataFrame:
    """Half-Kelly stakes between the limits for confident rows, with a readable bet id."""
    stake = F.least(F.col("kelly_fraction") * bankroll * share, F.lit(highest))
    name = F.replace(F.col(player), F.lit(" "), F.lit("_"))
    return opportunities.where(F.col("confidence_score") >= min_confidence).withColumn("bet_amount", stake).where(
        F.col("bet_amount") >= lowest).withColumn(
        "bet_id", F.concat_ws("_", F.date_format(day, "yyyy-MM-dd"), name, F.substring(F.col(stamp), -8, 8)))


# Percentile -> calibrated probability.
CALIBRATION = [(0, 0.05), (50, 0.12), (75, 0.18), (90, 0.25), (95, 0.30), (99, 0.35), (100, 0.35)]


def _interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    pieces = [
        (x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))) for (x0, y0), (x1, y1) in zip(points, points[1:])
    ]
    return first_matching([(x <= points[0][0], F.lit(points[0][1])), *pieces], F.lit(points[-1][1]))


def calibrate_percentile(
    df: DataFrame, p: str, groups: list[str] | None = None, points: list[tuple[float, float]] | None = CALIBRATION,
) -> DataFrame:
    """Average-rank percentile mapped piecewise linearly; without points, 0.05 + 0.25 x percentile."""
    keys = groups or []
    ranks = average_rank(df, p, keys)
    share = F.col("avg_rank") / F.col("group_n")
    value = _interpolate(share * 100, points) if points else 0.05 + share * 0.25
    return df.join(ranks.select(*keys, p, value.alias("calibrated")), [*keys, p], "left")


def calibrate_logit(p: Column, factor: float = 0.1, shift: float = -3.5) -> Column:
    """Logistic of a shrunk and shifted log-odds."""
    q = clip(p, 1e-7, 1 - 1e-7)
    return 1 / (1 + F.exp(-(F.ln(q / (1 - q)) * factor + shift)))


def scale_factor(p: Column, factor: float = 1.0) -> Column:
    """Plain scaling."""
    return p * factor


def best_offer_per_key(quotes: DataFrame, keys: list[str], bookmaker: str, over: str, under: str) -> DataFrame:
    """The highest over-price per key, its other side and no-vig probability; ties go to the first bookmaker name."""
    best = F.min_by(F.struct(bookmaker, over, under), F.struct(-F.col(over), F.col(bookmaker)))
    return quotes.where(F.col(over).isNotNull()).groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*").withColumn(
        "no_vig_probability", no_vig_probability(F.col(over), F.col(under)))


def ledger_summary(bets: DataFrame, day: str = "date", first: str | None = None, last: str | None = None) -> DataFrame:
    """Per day and overall (null day): counts, stakes, profit, averages, win rate, ROI, profit per settled bet."""
    rows = bets
    if first:
        rows = rows.where(F.col(day) >= F.lit(first).cast("date"))
    if last:
        rows = rows.where(F.col(day) <= F.lit(last).cast("date"))

    def n(condition: Column) -> Column:
        return F.sum(condition.cast("bigint"))

    def zero(column: Column) -> Column:
        return F.coalesce(column, F.lit(0.0))

    out = rows.groupingSets([[F.col(day)], []], F.col(day)).agg(
        F.count(F.lit(1)).alias("total_bets"), n(F.col("status") != "pending").alias("settled_bets"),
        n(F.col("status") == "won").alias("wins"), n(F.col("status") == "lost").alias("losses"),
        zero(F.sum("bet_amount")).alias("total_wagered"), zero(F.sum("profit_loss")).alias("total_profit_loss"),
        zero(F.avg("model_probability")).alias("avg_model_probability"), zero(F.avg("expected_value")).alias("avg_expected_value"),
        zero(F.avg("confidence_score")).alias("avg_confidence_score"),
    )
    settled = F.col("settled_bets")
    return out.withColumns({
        "win_rate": F.when(settled > 0, F.col("wins") / settled).otherwise(0.0),
        "roi": F.when(F.col("total_wagered") > 0, F.col("total_profit_loss") / F.col("total_wagered")).otherwise(0.0),
        "actual_ev_per_bet": F.when(settled > 0, F.col("total_profit_loss") / settled).otherwise(0.0),
    })


def daily_exposure(bets: DataFrame, day: str = "date", stake: str = "bet_amount") -> DataFrame:
    """Total stake per day."""
    return bets.groupBy(day).agg(F.coalesce(F.sum(stake), F.lit(0.0)).alias("daily_risk"))


def opportunity_summary(priced: DataFrame, opportunities: DataFrame, p: str, odds: str) -> DataFrame:
    """One row of counts, rates and averages over quoted rows and opportunities."""
    quoted = priced.where(F.col(odds).isNotNull()).agg(
        F.count(F.lit(1)).alias("total_players_with_odds"), F.avg(p).alias("avg_model_probability"),
        F.avg("expected_value").alias("avg_expected_value"), F.sum((F.col("expected_value") > 0).cast("bigint")).alias("positive_ev_count"))
    chosen = opportunities.agg(
        F.count(F.lit(1)).alias("n"), F.max("expected_value").alias("best"), F.avg("expected_value").alias("mean"),
        F.sum("kelly_fraction").alias("kelly"), F.avg("confidence_score").alias("confidence"))
    c = chosen.select(F.struct("*")).scalar()
    return quoted.withColumns({
        "total_opportunities": c["n"], "opportunity_rate": F.when(F.col("total_players_with_odds") > 0, c["n"] / F.col("total_players_with_odds")).otherwise(0.0),
        "best_ev": c["best"], "avg_opportunity_ev": c["mean"], "total_kelly_allocation": c["kelly"], "avg_confidence": c["confidence"],
    })
