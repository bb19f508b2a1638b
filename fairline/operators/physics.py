"""Weather, air, park and calendar factors (M1-M13): column expressions only, one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline import schema
from fairline.functions.columns import clip, first_matching
from fairline.operators.clean import BINS, bin_column, categorise_direction


def weather_factors(df: DataFrame) -> DataFrame:
    """M1: piecewise hit factors of temperature, wind, humidity and pressure, with their bins."""
    t, w, h, p = (F.col(c) for c in ("temperature", "wind_speed", "humidity", "pressure"))
    heat = first_matching([(t < 70, 0.85 + (t - 50) * 0.0075), (t < 85, 1.0 + (t - 70) * 0.02)], 1.3 - (t - 85) * 0.01)
    breeze = F.when(w < 15, 1.0 + w * 0.02).otherwise(1.3 - (w - 15) * 0.01)
    damp = F.when(h < 50, 1.1 - h * 0.002).otherwise(1.1 - (h - 50) * 0.004)
    return df.withColumns({
        "temp_hr_factor": clip(heat, 0.7, 1.4), "wind_hr_factor": clip(breeze, 0.8, 1.5),
        "humidity_hr_factor": clip(damp, 0.85, 1.15), "pressure_hr_factor": clip(1.0 + (29.92 - p) * 0.05, 0.9, 1.1),
        "temp_category": bin_column(t, *BINS["temperature"]), "wind_category": bin_column(w, *BINS["wind"]),
    })


def air_density_features(df: DataFrame) -> DataFrame:
    """M2: humid-air density in lb/ft3, its ratio to 0.075, and the distance and drag factors."""
    kelvin = (F.col("temperature") - 32) * 5 / 9 + 273.15
    pascal = F.col("pressure") * 3386.39
    vapour = F.col("humidity") / 100 * 610.7 * F.exp(17.27 * (kelvin - 273.15) / (kelvin - 35.85))
    density = ((pascal - vapour) / (287.05 * kelvin) + vapour / (461.5 * kelvin)) * 0.062428
    return df.withColumn("air_density", density).withColumn("air_density_ratio", F.col("air_density") / 0.075).withColumns({
        "flight_distance_factor": 1 / F.col("air_density_ratio"), "drag_factor": F.col("air_density_ratio")})


def _by_name(column: str, values: dict[str, float], default: float) -> Column:
    return first_matching([(F.col(column) == k, F.lit(v)) for k, v in values.items()], F.lit(default))


def wind_features(df: DataFrame, place: str = "stadium") -> DataFrame:
    """M3: direction class, stadium amplification, wind along the hit direction and its assistance factor."""
    along = F.col("wind_speed") * F.cos(F.radians(F.col("wind_direction") - 90))
    return df.withColumns({
        "wind_direction_category": categorise_direction(F.col("wind_direction")),
        "stadium_wind_factor": _by_name(place, schema.WIND_AMPLIFICATION, 1.0), "effective_wind_speed": along,
        "wind_assistance_factor": clip(1.0 + along * 0.02, 0.7, 1.4),
    })


def weather_indices(df: DataFrame, place: str = "stadium") -> DataFrame:
    """M4: blended favourability, carry index, elevation factor and their product."""
    blend = {"temp_hr_factor": 0.3, "wind_hr_factor": 0.25, "humidity_hr_factor": 0.2, "pressure_hr_factor": 0.15,
             "wind_assistance_factor": 0.1}
    index = sum((F.col(c) * w for c, w in blend.items()), F.lit(0.0))
    out = df.withColumns({
        "weather_favorability_index": index,
        "atmospheric_carry_index": F.col("flight_distance_factor") * 0.6 + F.col("wind_assistance_factor") * 0.4,
        "elevation_factor": _by_name(place, schema.ELEVATION_FACTOR, 1.0),
    })
    return out.withColumns({
        "weather_category": bin_column(F.col("weather_favorability_index"), *BINS["favorability"]),
        "ballpark_weather_factor": F.col("weather_favorability_index") * F.col("elevation_factor"),
    })


def park_table(spark: SparkSession) -> DataFrame:
    """The fixed park dimensions (ten rows), safe to broadcast."""
    return F.broadcast(spark.createDataFrame(schema.PARKS, schema.PARK_SCHEMA))


def attach_dimensions(df: DataFrame, dims: DataFrame, place: str = "stadium") -> DataFrame:
    """Park dimensions by name; the ``park_*`` functions below read them."""
    return df.join(dims, place, "left")


def _or_zero(columns: dict[str, Column], default: float = 0.0) -> dict[str, Column]:
    return {n: F.coalesce(c, F.lit(default)) for n, c in columns.items()}


def _average(kind: str) -> Column:
    return (F.col(f"lf_{kind}") + F.col(f"cf_{kind}") + F.col(f"rf_{kind}")) / 3


def park_dimension_features(df: DataFrame) -> DataFrame:
    """M5: raw dimensions, difficulty, asymmetry, wall and foul-territory factors; unknown park 0."""
    foul = F.col("foul")
    return df.withColumns(_or_zero({
        "park_left_field_distance": F.col("lf_dist"), "park_center_field_distance": F.col("cf_dist"),
        "park_right_field_distance": F.col("rf_dist"), "park_left_field_height": F.col("lf_wall"),
        "park_center_field_height": F.col("cf_wall"), "park_right_field_height": F.col("rf_wall"),
        "park_foul_territory_size": F.when(foul == "small", 1.0).when(foul == "medium", 2.0).when(foul == "large", 3.0),
        "park_elevation": F.col("elevation"), "park_is_dome": F.col("dome").cast("double"),
        "park_surface_turf": (F.col("surface") == "turf").cast("double"),
        "park_hr_difficulty_index": (_average("dist") - 320) / 10 + (_average("wall") - 10) / 5,
        "park_symmetry_factor": F.abs(F.col("lf_dist") - F.col("rf_dist")) / 50,
        "park_wall_height_factor": (_average("wall") - 8) / 10,
        "park_foul_territory_hr_boost": F.when(foul == "small", 0.05).when(foul == "large", -0.03).when(foul.isNotNull(), 0.0),
    }))


def park_carry_features(df: DataFrame, place: str = "stadium") -> DataFrame:
    """M6: elevation carry, thin-air factor (altitude and temperature), dome and coast reductions."""
    t = F.coalesce(F.col("temperature"), F.lit(70.0)) if "temperature" in df.columns else F.lit(70.0)
    known = F.col("elevation").isNotNull()
    density = F.exp(-F.col("elevation") * 0.00012) * (273.15 + 15) / (273.15 + (t - 32) * 5 / 9)
    return df.withColumns(_or_zero({
        "park_elevation_carry_boost": (F.col("elevation") - 500) / 1000 * 0.06, "park_air_density_factor": 1 - density,
        "park_dome_carry_reduction": F.when(F.col("dome") == 1, -0.02),
        "park_coastal_humidity_factor": F.when(known & F.col(place).isin(schema.COASTAL_PARKS), -0.015),
    }))


def park_direction_features(df: DataFrame) -> DataFrame:
    """M7: pull, opposite-field and centre-field factors."""
    left = (330 - F.col("rf_dist")) / 20 + (8 - F.col("rf_wall")) / 10
    right = (330 - F.col("lf_dist")) / 20 + (8 - F.col("lf_wall")) / 10
    return df.withColumns(_or_zero({
        "park_pull_factor_left": left, "park_pull_factor_right": right,
        "park_opposite_field_factor": F.least(left, right) * 0.7,
        "park_center_field_factor": (410 - F.col("cf_dist")) / 30 + (10 - F.col("cf_wall")) / 15,
    }))


def park_weather_interaction(df: DataFrame, place: str = "stadium") -> DataFrame:
    """M8: wind, temperature and humidity effects of a park and their combined multiplier."""
    elevation, dome = F.col("elevation"), F.col("dome") == 1
    wind = F.coalesce(F.col("wind_speed"), F.lit(5.0))
    special = [(F.col(place) == k, wind * v) for k, v in schema.WIND_INTERACTION.items()]
    heat = F.coalesce(F.col("temperature"), F.lit(70.0)) - 70
    damp = F.coalesce(F.col("humidity"), F.lit(50.0)) - 50
    known = elevation.isNotNull()
    out = df.withColumns(_or_zero({
        "park_wind_interaction": F.when(known, first_matching([*special, (dome, F.lit(0.0))], wind * 0.15)),
        "park_temperature_interaction": F.when(known, first_matching([(elevation > 3000, heat * 0.02), (dome, F.lit(0.0))], heat * 0.01)),
        "park_humidity_interaction": F.when(known, F.when(elevation < 500, -damp * 0.001).otherwise(-damp * 0.0005)),
    }))
    return out.withColumn("park_weather_hr_multiplier", 1 + F.col("park_wind_interaction") * 0.01
                          + F.col("park_temperature_interaction") + F.col("park_humidity_interaction"))


def park_calendar_effects(df: DataFrame, date: str = "date", place: str = "stadium", game_date: str = "game_date") -> DataFrame:
    """M9: day/night constants (only with a game date) and the season effect by latitude."""
    month, latitude = F.month(date), F.col("latitude")
    season = first_matching([
        ((latitude > 42) & month.isin(4, 5, 9, 10), F.lit(-0.03)), ((latitude > 42) & month.isin(6, 7, 8), F.lit(0.02)),
        ((latitude < 30) & month.isin(7, 8), F.lit(-0.01)),
    ], F.lit(0.0))
    light = _by_name(place, schema.DAY_NIGHT_FACTOR, 0.0) if game_date in df.columns else F.lit(0.0)
    return df.withColumns({"park_day_night_factor": light, "park_season_factor": season})


def park_context(df: DataFrame) -> DataFrame:
    """Offence, pitcher and defence context."""
    foul = F.when(F.col("foul") == "small", 0.02).when(F.col("foul") == "large", -0.02).when(F.col("foul").isNotNull(), 0.0)
    offence = (330 - _average("dist")) / 100 + (8 - _average("wall")) / 20 + foul + F.col("elevation") / 5000 * 0.1
    return df.withColumns(_or_zero({
        "park_offense_context": offence, "park_pitcher_context": -offence,
        "park_defensive_context": foul * 2 + F.when(F.col("surface") == "turf", 0.01).otherwise(0.0),
    }))


def circadian_features(df: DataFrame, hour: str = "game_hour", peak: int = 14, amplitude: float = 0.1) -> DataFrame:
    """Daily rhythm factor, time windows and penalties by start hour."""
    h = F.col(hour)
    return df.withColumns({
        "circadian_performance_factor": 1 - amplitude * (1 - F.cos((h - peak) * 2 * F.pi() / 24)),
        "optimal_time_window": h.between(13, 16).cast("int"),
        "suboptimal_time_penalty": F.when(h < 10, 0.05).when(h > 22, 0.03).otherwise(0.0),
        "night_game_indicator": (h >= 18).cast("int"), "afternoon_game_boost": F.when(h.between(12, 16), 0.02).otherwise(0.0),
        "evening_game_factor": F.when(h.between(17, 21), 0.01).otherwise(0.0),
    })


# Energy level by month (others 1.0).
MONTH_ENERGY = {3: 1.05, 4: 1.02, 5: 1.0, 6: 0.98, 7: 0.95, 8: 0.93, 9: 1.01, 10: 1.03, 11: 0.9}


def season_energy(df: DataFrame, date: str = "date") -> DataFrame:
    """Season progress and fatigue, monthly energy, dog days, early-season and September effects."""
    month, dom = F.month(date), F.dayofmonth(date)
    progress = clip((F.dayofyear(date) - 90) / 210.0, 0.0, 1.0)
    return df.withColumns({
        "season_progression": progress, "season_fatigue_factor": progress * 0.15,
        "monthly_energy_level": first_matching([(month == m, F.lit(v)) for m, v in MONTH_ENERGY.items()], F.lit(1.0)),
        "dog_days_effect": F.when(((month == 7) & (dom > 20)) | (month == 8), -0.02).otherwise(0.0),
        "spring_training_carryover": F.when(month.isin(3, 4) | ((month == 5) & (dom <= 15)), 0.01).otherwise(0.0),
        "playoff_chase_energy": F.when(month == 9, 0.015).otherwise(0.0),
    })


def performance_timing(df: DataFrame, hour: str = "game_hour") -> DataFrame:
    """13-17 window, timing penalties, distance from 15:00."""
    h = F.col(hour)
    inside = h.between(13, 17)
    return df.withColumns({
        "optimal_performance_window": inside.cast("int"), "suboptimal_timing_penalty": F.when(h < 11, 0.03).when(h > 22, 0.02).otherwise(0.0),
        "circadian_mismatch": F.least(F.abs(h - 15) / 12.0, F.lit(1.0)), "time_preference_alignment": inside.cast("double"),
    })
