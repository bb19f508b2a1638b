"""M14-M20 on events: base features are plain expressions of the event columns."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fairline.bindings.frames import EV, ev
from fairline.bindings.registry import query
from fairline.functions.columns import one_row
from fairline.operators import interaction as I

# Expressions both engines read alike.
BASE = {
    "power_form_hr_rate": "x / 1000", "power_form_avg_ev": "60 + angle / 2", "power_form_hard_hit_rate": "angle / 200",
    "park_elevation_carry_boost": "hr / 100.0", "weather_favorability_index": "0.8 + hr / 50.0", "hot_streak_intensity": "angle / 300",
    "cold_streak_depth": "hr / 500.0", "confidence_indicator": "0.5 + angle / 80", "momentum_strength": "x / 700 + hit", "mental_toughness": "hr / 30.0",
    "energy_reserves": "0.3 + hr / 35.0", "circadian_performance_factor": "0.8 + hr / 120.0", "rest_quality_score": "0.5 + angle / 220",
    "matchup_hr_rate_career": "angle / 900", "park_wind_interaction": "x / 50", "wind_hr_factor": "0.8 + angle / 200",
    "park_temperature_interaction": "(hr - 10) / 100.0", "temp_hr_factor": "0.7 + angle / 150", "clutch_hr_rate": "x / 800", "pressure_response": "angle / 70",
    "current_hot_streak": "hr % 6", "current_cold_streak": "(hr + 3) % 7", "fatigue_level": "angle / 100", "power_momentum_7d": "x / 300",
    "jet_lag_factor": "(hr % 4) / 60.0", "batter_park_hr_rate_boost": "(angle - 50) / 100", "park_pull_factor_left": "(hr - 12) / 6.0",
    "trend_acceleration": "(angle - 40) / 500", "breakout_velocity": "x / 900", "recovery_status": "0.5 + hr / 50.0",
    "contact_form_consistency": "angle / 250", "schedule_intensity": "hr / 24.0", "pressure_performance_index": "0.4 + angle / 90",
    "clutch_pa_percentage": "hr / 60.0", "risp_percentage": "angle / 180", "matchup_familiarity_score": "angle / 120", "park_weather_hr_multiplier": "0.9 + x / 2000",
}
# An exponent makes a literal a double in both engines (a bare decimal would be a fixed-point number in Spark).
BASE = {n: re.sub(r"(\d+\.\d+)", r"\1e0", e) for n, e in BASE.items()}
SRC = EV + ", b AS (SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in BASE.items()) + " FROM ev)"


def base(spark, sf):
    return ev(spark, sf).select("event_id", *[F.expr(e).cast("double").alias(n) for n, e in BASE.items()])


def _register(name: str, columns: dict[str, str], fn, source: str = SRC, relation: str = "b") -> None:
    @query(name, "event_id:l " + " ".join(f"{c}:f" for c in columns), f"WITH {source} SELECT event_id, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {relation}")
    def _(spark, sf):
        return fn(base(spark, sf))


_register("m14_multiplicative_interactions", {
    "power_form_altitude_boost": "power_form_hr_rate * (1 + park_elevation_carry_boost)", "power_weather_synergy": "power_form_avg_ev * weather_favorability_index",
    "hot_streak_confidence_boost": "hot_streak_intensity * confidence_indicator", "momentum_toughness_factor": "momentum_strength * mental_toughness",
    "energy_circadian_factor": "energy_reserves * circadian_performance_factor", "rested_momentum_boost": "rest_quality_score * momentum_strength",
    "matchup_form_synergy": "matchup_hr_rate_career * power_form_hr_rate", "park_wind_amplification": "park_wind_interaction * wind_hr_factor",
    "park_temp_amplification": "park_temperature_interaction * temp_hr_factor", "clutch_pressure_performance": "clutch_hr_rate * pressure_response",
}, I.multiplicative_interactions)
_register("m15_conditional_interactions", {
    "hot_streak_power_boost": "CASE WHEN current_hot_streak >= 3 THEN 1.15 ELSE 1 END * power_form_hr_rate",
    "cold_streak_confidence_penalty": "CASE WHEN current_cold_streak >= 4 THEN 0.85 ELSE 1 END * confidence_indicator",
    "fatigue_momentum_penalty": "CASE WHEN fatigue_level > 0.6 THEN 0.8 ELSE 1 END * power_momentum_7d",
    "jet_lag_circadian_disruption": "CASE WHEN jet_lag_factor > 0.02 THEN 1 - jet_lag_factor ELSE 1 END * circadian_performance_factor",
    "park_advantage_pull_boost": "CASE WHEN batter_park_hr_rate_boost > 0.05 THEN 1.2 ELSE 1 END * park_pull_factor_left",
}, I.conditional_interactions)


def mm(c: str) -> str:
    return f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-8)"


COMP = {
    "composite_power_index": f"({mm('power_form_hr_rate')} + {mm('power_form_avg_ev')} + {mm('power_form_hard_hit_rate')}) / 3",
    "composite_momentum_index": f"({mm('momentum_strength')} + {mm('trend_acceleration')} + {mm('breakout_velocity')}) / 3",
    "environmental_favorability_index": "(park_elevation_carry_boost + temp_hr_factor + wind_hr_factor) / 3",
    "physical_condition_index": "(energy_reserves + rest_quality_score + recovery_status) / 3",
    "psychological_state_index": "(confidence_indicator + mental_toughness + pressure_response) / 3",
}
SRC2 = SRC + ", c AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in COMP.items()) + " FROM b)"


def composites(df):
    return I.composite_indices(df, one_row(I.global_statistics(df), cut=True))


_register("m16_minmax_composite", COMP, composites)
_register("m17_ratio_interactions", {
    "power_contact_ratio": "power_form_hr_rate / (contact_form_consistency + 0.01)", "momentum_fatigue_ratio": "momentum_strength / (fatigue_level + 0.01)",
    "rest_workload_ratio": "rest_quality_score / (schedule_intensity + 0.01)", "performance_pressure_ratio": "power_form_hr_rate / (1 / (pressure_performance_index + 0.01))",
    "hot_cold_balance": "hot_streak_intensity / (cold_streak_depth + 0.01)",
}, I.ratio_interactions)


def above(c: str, q: float) -> str:
    return f"CASE WHEN {c} > (SELECT quantile_cont({c}, {q}) FROM b) THEN 1 ELSE 0 END"


SRC3 = SRC2 + f""", q AS (SELECT *, {above('power_form_hr_rate', 0.8)} AS elite_power_indicator, {above('momentum_strength', 0.75)} AS high_momentum_indicator,
  {above('fatigue_level', 0.9)} AS extreme_fatigue_indicator, CASE WHEN energy_reserves > 0.8 THEN 1 ELSE 0 END + CASE WHEN confidence_indicator > 1.1 THEN 1 ELSE 0 END
  + CASE WHEN environmental_favorability_index > 1.05 THEN 1 ELSE 0 END AS optimal_conditions_indicator FROM c)"""
QUANT = {n: n for n in ("elite_power_indicator", "high_momentum_indicator", "extreme_fatigue_indicator", "optimal_conditions_indicator")}
QUANT["elite_performance_convergence"] = "elite_power_indicator + high_momentum_indicator + CASE WHEN optimal_conditions_indicator >= 2 THEN 1 ELSE 0 END"


def quantiles(df):
    stats = one_row(I.global_statistics(df), cut=True)
    return I.quantile_indicators(I.composite_indices(df, stats), stats)


_register("m18_quantile_indicators", QUANT, quantiles, SRC3, "q")
SYN = {
    "mind_body_synergy": "physical_condition_index * psychological_state_index", "form_environment_synergy": "composite_power_index * environmental_favorability_index",
    "momentum_opportunity_synergy": "composite_momentum_index * (clutch_pa_percentage + risp_percentage) / 2",
    "experience_pressure_synergy": "matchup_familiarity_score * pressure_performance_index", "rest_performance_synergy": "physical_condition_index * power_form_hr_rate",
}
_register("m19_cross_domain_synergies", SYN, lambda df: I.cross_domain_synergies(composites(df)), SRC2, "c")
OVERALL = "circadian_performance_factor * energy_reserves * (confidence_indicator / (SELECT avg(confidence_indicator) FROM b)) * park_weather_hr_multiplier"
MULT = {
    "overall_performance_multiplier": OVERALL,
    "clutch_performance_multiplier": f"{OVERALL} * CASE WHEN clutch_hr_rate > (SELECT avg(clutch_hr_rate) FROM b) THEN 1.1 ELSE 1 END",
    "hot_streak_performance_multiplier": f"{OVERALL} * (1 + 0.2 * hot_streak_intensity)", "fatigue_adjusted_multiplier": f"{OVERALL} * (1 - 0.3 * fatigue_level)",
}
_register("m20_performance_multipliers", MULT, lambda df: I.performance_multipliers(df, one_row(I.global_statistics(df), cut=True)))
