"""M1-M13 on events and orders; stadium names are spread over the users."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline import schema
from fairline.bindings.frames import EV, ev
from fairline.bindings.registry import query, table
from fairline.operators import physics as M

PLACES = [r[0] for r in schema.PARKS] + ["Chase Field", "Unknown Park"]
# Expressions both engines read alike.
INPUTS = {
    "temperature": "CASE WHEN event_type = 'error' THEN NULL ELSE 30 + x END", "wind_speed": "angle / 4",
    "humidity": "angle", "pressure": "28.5 + hr / 10.0", "wind_direction": "CAST(hr * 15 AS DOUBLE)",
}
COUNT = len(PLACES)
SRC = (EV + ", w AS (SELECT event_id, day AS date, day AS game_date, hr AS game_hour, " + ", ".join(f"{e} AS {n}" for n, e in INPUTS.items())
       + ", CASE CAST(user_id % " + str(COUNT) + " AS INTEGER) " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PLACES)) + " END AS stadium FROM ev)")
DIMS = ("dim(stadium, lf_dist, cf_dist, rf_dist, lf_wall, cf_wall, rf_wall, foul, elevation, latitude, longitude, dome, surface) AS (VALUES "
        + ", ".join("('{}', {}, {}, {}, {}, {}, {}, '{}', {}, {}, {}, {}, '{}')".format(
            r[0], *[f"CAST({v} AS DOUBLE)" for v in r[1:7]], r[7], *[f"CAST({v} AS DOUBLE)" for v in r[8:11]], r[11], r[12])
            for r in schema.PARKS) + ")")
PARK = f"{SRC}, {DIMS}, pk AS (SELECT w.*, dim.* EXCLUDE (stadium) FROM w LEFT JOIN dim USING (stadium))"


def weather_rows(spark, sf):
    names = F.element_at(F.array(*[F.lit(p) for p in PLACES]), (F.col("user_id") % COUNT + 1).cast("int"))
    return ev(spark, sf).select(
        "event_id", F.col("day").alias("date"), F.col("day").alias("game_date"), F.col("hr").alias("game_hour"),
        *[F.expr(e).cast("double").alias(n) for n, e in INPUTS.items()], names.alias("stadium"))


def park_rows(spark, sf):
    return M.attach_dimensions(weather_rows(spark, sf), M.park_table(spark))


F1 = """f1 AS (SELECT *, CASE WHEN temperature IS NOT NULL THEN least(greatest(CASE WHEN temperature < 70 THEN 0.85 + (temperature - 50) * 0.0075 WHEN temperature < 85
  THEN 1 + (temperature - 70) * 0.02 ELSE 1.3 - (temperature - 85) * 0.01 END, 0.7), 1.4) END AS temp_hr_factor,
  least(greatest(CASE WHEN wind_speed < 15 THEN 1 + wind_speed * 0.02 ELSE 1.3 - (wind_speed - 15) * 0.01 END, 0.8), 1.5) AS wind_hr_factor,
  least(greatest(CASE WHEN humidity < 50 THEN 1.1 - humidity * 0.002 ELSE 1.1 - (humidity - 50) * 0.004 END, 0.85), 1.15) AS humidity_hr_factor,
  least(greatest(1 + (29.92 - pressure) * 0.05, 0.9), 1.1) AS pressure_hr_factor FROM w)"""
F2 = """f2 AS (SELECT *, 1 / ratio AS flight FROM (SELECT *, ((p - v) / (287.05 * k) + v / (461.5 * k)) * 0.062428 AS air_density,
  ((p - v) / (287.05 * k) + v / (461.5 * k)) * 0.062428 / 0.075 AS ratio FROM (SELECT *, humidity / 100 * 610.7 * exp(17.27 * (k - 273.15) / (k - 35.85)) AS v
  FROM (SELECT *, (temperature - 32) * 5 / 9 + 273.15 AS k, pressure * 3386.39 AS p FROM f1))))"""
F3 = """f3 AS (SELECT *, wind_speed * cos(radians(wind_direction - 90)) AS eff, least(greatest(1 + wind_speed * cos(radians(wind_direction - 90)) * 0.02, 0.7), 1.4) AS assist,
  CASE stadium WHEN 'Wrigley Field' THEN 1.3 WHEN 'Coors Field' THEN 1.1 WHEN 'Minute Maid Park' THEN 0.3 WHEN 'Tropicana Field' THEN 0.1 ELSE 1.0 END AS amp FROM f2)"""


@query("m1_weather_factors", "event_id:l temp_hr_factor:f wind_hr_factor:f humidity_hr_factor:f pressure_hr_factor:f", f"WITH {SRC}, {F1} SELECT * FROM f1")
def _(spark, sf):
    return M.weather_factors(weather_rows(spark, sf))


@query("m2_air_density_features", "event_id:l air_density:f air_density_ratio:f flight_distance_factor:f drag_factor:f", f"""
WITH {SRC}, {F1}, {F2} SELECT event_id, air_density, ratio AS air_density_ratio, flight AS flight_distance_factor, ratio AS drag_factor FROM f2""")
def _(spark, sf):
    return M.air_density_features(weather_rows(spark, sf))


@query("m3_wind_features", "event_id:l stadium_wind_factor:f effective_wind_speed:f wind_assistance_factor:f wind_direction_category:s", f"""
WITH {SRC}, {F1}, {F2}, {F3} SELECT event_id, amp AS stadium_wind_factor, eff AS effective_wind_speed, assist AS wind_assistance_factor,
  CASE WHEN wind_direction BETWEEN 45 AND 135 THEN 'favorable' WHEN wind_direction BETWEEN 225 AND 315 THEN 'unfavorable' ELSE 'neutral' END AS wind_direction_category FROM f3""")
def _(spark, sf):
    return M.wind_features(weather_rows(spark, sf))


@query("m4_weather_indices", "event_id:l weather_favorability_index:f atmospheric_carry_index:f elevation_factor:f ballpark_weather_factor:f weather_category:s", f"""
WITH {SRC}, {F1}, {F2}, {F3}, i AS (SELECT *, temp_hr_factor * 0.3 + wind_hr_factor * 0.25 + humidity_hr_factor * 0.2 + pressure_hr_factor * 0.15 + assist * 0.1 AS fav,
  CASE stadium WHEN 'Coors Field' THEN 1.15 WHEN 'Chase Field' THEN 1.05 WHEN 'Kauffman Stadium' THEN 1.03 ELSE 1.0 END AS elev FROM f3)
SELECT event_id, fav AS weather_favorability_index, flight * 0.6 + assist * 0.4 AS atmospheric_carry_index, elev AS elevation_factor, fav * elev AS ballpark_weather_factor,
  CASE WHEN fav > 0 AND fav <= 0.9 THEN 'unfavorable' WHEN fav > 0.9 AND fav <= 1.1 THEN 'neutral' WHEN fav > 1.1 AND fav <= 2 THEN 'favorable' END AS weather_category FROM i""")
def _(spark, sf):
    return M.weather_indices(M.wind_features(M.air_density_features(M.weather_factors(weather_rows(spark, sf)))))


M5 = {
    "park_left_field_distance": "lf_dist", "park_foul_territory_size": "CASE foul WHEN 'small' THEN 1 WHEN 'medium' THEN 2 WHEN 'large' THEN 3 END",
    "park_elevation": "elevation", "park_is_dome": "dome", "park_surface_turf": "CASE WHEN surface = 'turf' THEN 1 ELSE 0 END",
    "park_hr_difficulty_index": "((lf_dist + cf_dist + rf_dist) / 3 - 320) / 10 + ((lf_wall + cf_wall + rf_wall) / 3 - 10) / 5",
    "park_symmetry_factor": "abs(lf_dist - rf_dist) / 50", "park_wall_height_factor": "((lf_wall + cf_wall + rf_wall) / 3 - 8) / 10",
    "park_foul_territory_hr_boost": "CASE foul WHEN 'small' THEN 0.05 WHEN 'large' THEN -0.03 ELSE 0 END",
}
M6 = {
    "park_elevation_carry_boost": "(elevation - 500) / 1000 * 0.06",
    "park_air_density_factor": "1 - exp(-0.00012 * elevation) * 288.15 / (273.15 + (coalesce(temperature, 70) - 32) * 5 / 9)",
    "park_dome_carry_reduction": "CASE WHEN dome = 1 THEN -0.02 END",
    "park_coastal_humidity_factor": "CASE WHEN stadium IN ('Oracle Park', 'Petco Park', 'Tropicana Field') THEN -0.015 END",
}
M7 = {
    "park_pull_factor_left": "(330 - rf_dist) / 20 + (8 - rf_wall) / 10", "park_pull_factor_right": "(330 - lf_dist) / 20 + (8 - lf_wall) / 10",
    "park_opposite_field_factor": "0.7 * least((330 - rf_dist) / 20 + (8 - rf_wall) / 10, (330 - lf_dist) / 20 + (8 - lf_wall) / 10)",
    "park_center_field_factor": "(410 - cf_dist) / 30 + (10 - cf_wall) / 15",
}
M8 = {
    "park_wind_interaction": "coalesce(wind_speed, 5) * CASE WHEN lf_dist IS NULL THEN NULL WHEN stadium = 'Wrigley Field' THEN 0.3 WHEN stadium = 'Oracle Park' THEN 0.25 WHEN dome = 1 THEN 0 ELSE 0.15 END",
    "park_temperature_interaction": "(coalesce(temperature, 70) - 70) * CASE WHEN lf_dist IS NULL THEN NULL WHEN elevation > 3000 THEN 0.02 WHEN dome = 1 THEN 0 ELSE 0.01 END",
    "park_humidity_interaction": "(humidity - 50) * CASE WHEN lf_dist IS NULL THEN NULL WHEN elevation < 500 THEN -0.001 ELSE -0.0005 END",
}
M10 = {
    "park_offense_context": "(330 - (lf_dist + cf_dist + rf_dist) / 3) / 100 + (8 - (lf_wall + cf_wall + rf_wall) / 3) / 20 + CASE foul WHEN 'small' THEN 0.02 WHEN 'large' THEN -0.02 ELSE 0 END + elevation / 50000",
    "park_pitcher_context": "-((330 - (lf_dist + cf_dist + rf_dist) / 3) / 100 + (8 - (lf_wall + cf_wall + rf_wall) / 3) / 20 + CASE foul WHEN 'small' THEN 0.02 WHEN 'large' THEN -0.02 ELSE 0 END + elevation / 50000)",
    "park_defensive_context": "CASE foul WHEN 'small' THEN 0.04 WHEN 'large' THEN -0.04 ELSE 0 END + CASE WHEN surface = 'turf' THEN 0.01 ELSE 0 END",
}


def _park(name: str, columns: dict[str, str], fn, extra: str = "", extra_spec: str = "") -> None:
    body = ", ".join(f"coalesce(CASE WHEN lf_dist IS NOT NULL THEN {e} END, 0) AS {n}" for n, e in columns.items())

    @query(name, "event_id:l " + " ".join(f"{n}:f" for n in columns) + extra_spec, f"WITH {PARK}, r AS (SELECT event_id, {body} FROM pk) SELECT *{extra} FROM r")
    def _(spark, sf):
        return fn(park_rows(spark, sf))


_park("m5_park_dimension_features", M5, M.park_dimension_features)
_park("m6_park_carry_features", M6, M.park_carry_features)
_park("m7_park_direction_features", M7, M.park_direction_features)
_park("m8_park_weather_interaction", M8, M.park_weather_interaction,
      ", 1 + 0.01 * park_wind_interaction + park_temperature_interaction + park_humidity_interaction AS park_weather_hr_multiplier",
      " park_weather_hr_multiplier:f")
_park("m10_park_context", M10, M.park_context)


@query("m9_park_calendar_effects", "o_orderkey:l park_day_night_factor:f park_season_factor:f", f"""
WITH {DIMS}, o AS (SELECT o_orderkey, month(o_orderdate) AS m, CASE CAST(o_custkey % {COUNT} AS INTEGER) {' '.join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PLACES))} END AS stadium FROM orders)
SELECT o_orderkey, CASE stadium WHEN 'Wrigley Field' THEN 0.02 WHEN 'Fenway Park' THEN -0.01 ELSE 0 END AS park_day_night_factor,
  CASE WHEN latitude > 42 AND m IN (4, 5, 9, 10) THEN -0.03 WHEN latitude > 42 AND m IN (6, 7, 8) THEN 0.02 WHEN latitude < 30 AND m IN (7, 8) THEN -0.01 ELSE 0 END AS park_season_factor
FROM o LEFT JOIN dim USING (stadium)""")
def _(spark, sf):
    names = F.element_at(F.array(*[F.lit(p) for p in PLACES]), (F.col("o_custkey") % COUNT + 1).cast("int"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), F.to_date("o_orderdate").alias("game_date"), names.alias("stadium"))
    return M.park_calendar_effects(M.attach_dimensions(rows, M.park_table(spark)))


@query("m11_circadian_features", "event_id:l circadian_performance_factor:f optimal_time_window:i suboptimal_time_penalty:f night_game_indicator:i "
       "afternoon_game_boost:f evening_game_factor:f", f"""
WITH {EV} SELECT event_id, 1 - 0.1 * (1 - cos(2 * pi() * (hr - 14) / 24)) AS circadian_performance_factor, CASE WHEN hr BETWEEN 13 AND 16 THEN 1 ELSE 0 END AS optimal_time_window,
  CASE WHEN hr < 10 THEN 0.05 WHEN hr > 22 THEN 0.03 ELSE 0 END AS suboptimal_time_penalty, CASE WHEN hr >= 18 THEN 1 ELSE 0 END AS night_game_indicator,
  CASE WHEN hr BETWEEN 12 AND 16 THEN 0.02 ELSE 0 END AS afternoon_game_boost, CASE WHEN hr BETWEEN 17 AND 21 THEN 0.01 ELSE 0 END AS evening_game_factor FROM ev""")
def _(spark, sf):
    return M.circadian_features(weather_rows(spark, sf))


@query("m12_season_energy", "o_orderkey:l season_progression:f season_fatigue_factor:f monthly_energy_level:f dog_days_effect:f spring_training_carryover:f playoff_chase_energy:f", """
SELECT o_orderkey, least(greatest((dayofyear(o_orderdate) - 90) / 210.0, 0), 1) AS season_progression, 0.15 * least(greatest((dayofyear(o_orderdate) - 90) / 210.0, 0), 1) AS season_fatigue_factor,
  CASE month(o_orderdate) WHEN 3 THEN 1.05 WHEN 4 THEN 1.02 WHEN 6 THEN 0.98 WHEN 7 THEN 0.95 WHEN 8 THEN 0.93 WHEN 9 THEN 1.01 WHEN 10 THEN 1.03 WHEN 11 THEN 0.9 ELSE 1 END AS monthly_energy_level,
  CASE WHEN month(o_orderdate) = 8 OR (month(o_orderdate) = 7 AND day(o_orderdate) > 20) THEN -0.02 ELSE 0 END AS dog_days_effect,
  CASE WHEN month(o_orderdate) IN (3, 4) OR (month(o_orderdate) = 5 AND day(o_orderdate) <= 15) THEN 0.01 ELSE 0 END AS spring_training_carryover,
  CASE WHEN month(o_orderdate) = 9 THEN 0.015 ELSE 0 END AS playoff_chase_energy FROM orders""")
def _(spark, sf):
    return M.season_energy(table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate")))


@query("m13_performance_timing", "event_id:l optimal_performance_window:i suboptimal_timing_penalty:f circadian_mismatch:f time_preference_alignment:f", f"""
WITH {EV} SELECT event_id, CASE WHEN hr BETWEEN 13 AND 17 THEN 1 ELSE 0 END AS optimal_performance_window, CASE WHEN hr < 11 THEN 0.03 WHEN hr > 22 THEN 0.02 ELSE 0 END AS suboptimal_timing_penalty,
  least(abs(hr - 15) / 12.0, 1) AS circadian_mismatch, CASE WHEN hr BETWEEN 13 AND 17 THEN 1 ELSE 0 END AS time_preference_alignment FROM ev""")
def _(spark, sf):
    return M.performance_timing(weather_rows(spark, sf))
