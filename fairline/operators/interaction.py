"""Interaction terms of finished features (M14-M20), generated from small spec tables.

A term appears only if all its inputs exist. Global statistics (extremes,
means, quantiles) come as one row, either of the table itself or fitted on a
training table and passed in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions.columns import flag, one_row
from fairline.functions.ordering import quantile_row

# Product terms (name, left, right, constant added to the right side).
PRODUCTS = [
    ("power_form_altitude_boost", "power_form_hr_rate", "park_elevation_carry_boost", 1),
    ("power_weather_synergy", "power_form_avg_ev", "weather_favorability_index", 0),
    ("hot_streak_confidence_boost", "hot_streak_intensity", "confidence_indicator", 0),
    ("momentum_toughness_factor", "momentum_strength", "mental_toughness", 0),
    ("energy_circadian_factor", "energy_reserves", "circadian_performance_factor", 0),
    ("rested_momentum_boost", "rest_quality_score", "momentum_strength", 0),
    ("matchup_form_synergy", "matchup_hr_rate_career", "power_form_hr_rate", 0),
    ("park_wind_amplification", "park_wind_interaction", "wind_hr_factor", 0),
    ("park_temp_amplification", "park_temperature_interaction", "temp_hr_factor", 0),
    ("clutch_pressure_performance", "clutch_hr_rate", "pressure_response", 0),
]
# Conditional terms (name, condition column, comparison, limit, value column, factor).
CONDITIONS = [
    ("hot_streak_power_boost", "current_hot_streak", ">=", 3, "power_form_hr_rate", 1.15),
    ("cold_streak_confidence_penalty", "current_cold_streak", ">=", 4, "confidence_indicator", 0.85),
    ("fatigue_momentum_penalty", "fatigue_level", ">", 0.6, "power_momentum_7d", 0.8),
    ("jet_lag_circadian_disruption", "jet_lag_factor", ">", 0.02, "circadian_performance_factor", None),
    ("park_advantage_pull_boost", "batter_park_hr_rate_boost", ">", 0.05, "park_pull_factor_left", 1.2),
]
# Composite indices (name, components, scaled to 0-1 first).
COMPOSITES = [
    ("composite_power_index", ["power_form_hr_rate", "power_form_avg_ev", "power_form_hard_hit_rate"], True),
    ("composite_momentum_index", ["momentum_strength", "trend_acceleration", "breakout_velocity"], True),
    ("environmental_favorability_index", ["park_elevation_carry_boost", "temp_hr_factor", "wind_hr_factor"], False),
    ("physical_condition_index", ["energy_reserves", "rest_quality_score", "recovery_status"], False),
    ("psychological_state_index", ["confidence_indicator", "mental_toughness", "pressure_response"], False),
]
# Ratio terms (name, top, bottom, multiply instead of divide).
RATIOS = [
    ("power_contact_ratio", "power_form_hr_rate", "contact_form_consistency", False),
    ("momentum_fatigue_ratio", "momentum_strength", "fatigue_level", False),
    ("rest_workload_ratio", "rest_quality_score", "schedule_intensity", False),
    ("performance_pressure_ratio", "power_form_hr_rate", "pressure_performance_index", True),
    ("hot_cold_balance", "hot_streak_intensity", "cold_streak_depth", False),
]
# Quantile indicators (name, column, fraction) and the three fixed-limit conditions.
INDICATORS = [
    ("elite_power_indicator", "power_form_hr_rate", 0.8), ("high_momentum_indicator", "momentum_strength", 0.75),
    ("extreme_fatigue_indicator", "fatigue_level", 0.9),
]
OPTIMAL = [("energy_reserves", 0.8), ("confidence_indicator", 1.1), ("environmental_favorability_index", 1.05)]
# Products of composites.
SYNERGIES = [
    ("mind_body_synergy", "physical_condition_index", "psychological_state_index"),
    ("form_environment_synergy", "composite_power_index", "environmental_favorability_index"),
    ("experience_pressure_synergy", "matchup_familiarity_score", "pressure_performance_index"),
    ("rest_performance_synergy", "physical_condition_index", "power_form_hr_rate"),
]


def _has(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def _product(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x * y, columns)


def multiplicative_interactions(df: DataFrame) -> DataFrame:
    """Products of two features."""
    return df.withColumns({n: F.col(x) * (F.col(y) + plus) for n, x, y, plus in PRODUCTS if _has(df, x, y)})


def conditional_interactions(df: DataFrame) -> DataFrame:
    """A feature scaled while a condition holds."""
    terms = {}
    for name, tested, sign, limit, value, factor in CONDITIONS:
        if _has(df, tested, value):
            holds = F.col(tested) >= limit if sign == ">=" else F.col(tested) > limit
            scale = F.lit(factor) if factor is not None else 1 - F.col(tested)
            terms[name] = F.when(holds, F.col(value) * scale).otherwise(F.col(value))
    return df.withColumns(terms)


def global_statistics(df: DataFrame) -> DataFrame:
    """One row of the extremes, means and quantiles M16, M18 and M20 need; may be fitted on a training table."""
    scaled = sorted({c for _, parts, scale in COMPOSITES if scale for c in parts if c in df.columns})
    averaged = [c for c in ("confidence_indicator", "clutch_hr_rate") if c in df.columns]
    plain = df.agg(
        F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{n}_{c}") for c in scaled for f, n in ((F.min, "min"), (F.max, "max"))],
        *[F.avg(c).alias(f"avg_{c}") for c in averaged],
    )
    wanted = {n: (c, q) for n, c, q in INDICATORS if c in df.columns}
    if not wanted:
        return plain
    quantiles = one_row(quantile_row(df, wanted))
    return plain.withColumns({f"q_{n}": quantiles[n] for n in wanted})


def composite_indices(df: DataFrame, stats: Column) -> DataFrame:
    """Means of at least two components, the scaled ones by global minimum and maximum."""
    terms = {}
    for name, parts, scale in COMPOSITES:
        present = [c for c in parts if c in df.columns]
        if len(present) >= 2:
            values = [
                (F.col(c) - stats[f"min_{c}"]) / (stats[f"max_{c}"] - stats[f"min_{c}"] + 1e-8) if scale else F.col(c)
                for c in present
            ]
            terms[name] = reduce(lambda x, y: x + y, values) / len(present)
    return df.withColumns(terms)


def ratio_interactions(df: DataFrame) -> DataFrame:
    """Ratios with 0.01 added below."""
    return df.withColumns({
        n: F.col(x) * (F.col(y) + 0.01) if multiply else F.col(x) / (F.col(y) + 0.01)
        for n, x, y, multiply in RATIOS if _has(df, x, y)
    })


def quantile_indicators(df: DataFrame, stats: Column) -> DataFrame:
    """Above-quantile flags, count of optimal conditions, convergence of the elite flags."""
    flags = {n: flag(F.col(c) > stats[f"q_{n}"]) for n, c, _ in INDICATORS if c in df.columns}
    good = [flag(F.col(c) > limit) for c, limit in OPTIMAL if c in df.columns]
    if good:
        flags["optimal_conditions_indicator"] = reduce(lambda x, y: x + y, good)
    out = df.withColumns(flags)
    elite = [F.col(c) for c in ("elite_power_indicator", "high_momentum_indicator") if c in out.columns]
    if good:
        elite.append(flag(F.col("optimal_conditions_indicator") >= 2))
    return out.withColumn("elite_performance_convergence", reduce(lambda x, y: x + y, elite)) if elite else out


def cross_domain_synergies(df: DataFrame) -> DataFrame:
    """Products of composites from different domains."""
    terms = {n: F.col(x) * F.col(y) for n, x, y in SYNERGIES if _has(df, x, y)}
    chances = [F.col(c) for c in ("clutch_pa_percentage", "risp_percentage") if c in df.columns]
    if chances and "composite_momentum_index" in df.columns:
        terms["momentum_opportunity_synergy"] = F.col("composite_momentum_index") * (reduce(lambda x, y: x + y, chances) / len(chances))
    return df.withColumns(terms)


def performance_multipliers(df: DataFrame, stats: Column) -> DataFrame:
    """Product of up to four components, adjusted for clutch, hot streak and fatigue."""
    parts = [F.col(c) for c in ("circadian_performance_factor", "energy_reserves") if c in df.columns]
    if "confidence_indicator" in df.columns:
        parts.append(F.col("confidence_indicator") / stats["avg_confidence_indicator"])
    if "park_weather_hr_multiplier" in df.columns:
        parts.append(F.col("park_weather_hr_multiplier"))
    if not parts:
        return df
    out, base, terms = df.withColumn("overall_performance_multiplier", _product(parts)), F.col("overall_performance_multiplier"), {}
    if "clutch_hr_rate" in df.columns:
        strong = F.col("clutch_hr_rate") > stats["avg_clutch_hr_rate"]
        terms["clutch_performance_multiplier"] = F.when(strong, base * 1.1).otherwise(base)
    if "hot_streak_intensity" in df.columns:
        terms["hot_streak_performance_multiplier"] = base * (1 + F.col("hot_streak_intensity") * 0.2)
    if "fatigue_level" in df.columns:
        terms["fatigue_adjusted_multiplier"] = base * (1 - F.col("fatigue_level") * 0.3)
    return out.withColumns(terms)


def feature_interactions(df: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """M14-M20 in order; ``fitted`` is the statistics row of a training table."""
    stats = one_row(fitted if fitted is not None else global_statistics(df), cut=True)
    out = conditional_interactions(multiplicative_interactions(df))
    out = ratio_interactions(composite_indices(out, stats))
    return performance_multipliers(cross_domain_synergies(quantile_indicators(out, stats)), stats)
