"""End-to-end plans a user calls (X1-X5), composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.operators import clean, evaluate, join, market, model
from fairline.plans.features import FeatureTable, build_feature_table, checked_feature_table, final_table  # noqa: F401  (X1)

def build_prediction_table(
    history: DataFrame, targets: DataFrame, name: str, target: str, date: str, order: list, template: list[str], means: list[str], days: int = 45,
    defaults: dict[str, float] | None = None, median_columns: tuple[str, ...] = (), zero_columns: tuple[str, ...] = (),
) -> DataFrame:
    """The last days of history matched to target names: newest row as template, means of the newest ten.

    Missing values are then filled by ``defaults``, medians or zero as P13 does.
    """
    recent = clean.filter_last_days(history, date, days)
    matches = join.match_names_contains(recent, name, targets, target)
    rows = join.template_rows(recent, matches, name, order, template, means)
    if not (defaults or median_columns or zero_columns):
        return rows
    return clean.fill_prediction_defaults(rows, defaults or {}, list(median_columns), list(zero_columns))


@dataclass
class DailyReport:
    opportunities: DataFrame
    near_misses: DataFrame
    summary: DataFrame


def daily_opportunities(
    predictions: DataFrame, odds: DataFrame, day: str, name: str, p: str, yes: str, no: str, key: str, min_ev: float = 0.05, min_confidence: float = 0.0,
) -> DailyReport:
    """Calibrate scores by percentile, attach quotes, price, rank (best expected value first) and summarise."""
    calibrated = market.calibrate_percentile(predictions, p).withColumn("model_probability", F.col("calibrated"))
    quoted = join.join_odds(calibrated, odds, day, name, [yes, no], "bookmaker")
    priced = market.price_market(quoted, "model_probability", yes, no)
    chosen = market.find_opportunities(priced, "model_probability", yes, min_ev=min_ev, min_confidence=min_confidence)
    return DailyReport(
        chosen.orderBy(F.desc("expected_value"), key), market.near_misses(priced, "model_probability", yes, key, min_ev=min_ev),
        market.opportunity_summary(priced, chosen, "model_probability", yes))


@dataclass
class TrainingReport:
    models: dict
    metrics: DataFrame
    calibration: DataFrame
    folds: DataFrame | None


def train_and_evaluate(
    df: DataFrame, features: list[str], label: str, date: str, kinds: tuple[str, ...] = ("logistic", "forest", "boosted"),
    settings: model.ModelSettings = model.ModelSettings(), folds: int = 0, threshold: float = 0.15,
) -> TrainingReport:
    """Split by time, train every kind, calibrate on validation rows, report on test rows, optional folds."""
    split = evaluate.time_split(df, date)
    train, validation, test = (split.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test"))
    metrics = calibration = None
    models = model.train_models(train, features, label, kinds, settings)
    for kind, fitted in models.items():
        isotonic = model.fit_isotonic(model.predict(fitted, validation, features), "probability_1", label)
        scored = model.apply_isotonic(isotonic, model.predict(fitted, test, features), "probability_1")
        m = evaluate.binary_metrics(scored, "calibrated", label, threshold).withColumn("model", F.lit(kind))
        c = evaluate.calibration_error(scored, "calibrated", label).withColumn("model", F.lit(kind))
        metrics = m if metrics is None else metrics.unionByName(m)
        calibration = c if calibration is None else calibration.unionByName(c)
    cv = model.expanding_cv(df, date, features, label, kinds[0], folds, settings, threshold) if folds else None
    return TrainingReport(models, metrics, calibration, cv)


def portfolio(
    priced: DataFrame, p: str, odds: str, day: str, key: str, bankroll: float = 1000.0, min_ev: float = 0.05, min_confidence: float = 0.0,
) -> DataFrame:
    """Opportunities sized against the bankroll and the daily limit."""
    chosen = market.find_opportunities(priced, p, odds, min_ev=min_ev, min_confidence=min_confidence)
    return market.size_bets_greedy_cap(chosen, day, key, bankroll)
