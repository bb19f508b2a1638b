"""Versioned keyed tables with merge and insert-or-ignore writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions.durable import materialise

# Measures of the pair table that merge by addition.
PAIR_SUMS = ["pa", "hr", "ev_sum", "ev_n", "la_sum", "la_n", "rows"]


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the version the pointer names, 0 before the first write."""
    try:
        return spark.read.parquet(f"{path}/current").agg(F.max("version")).first()[0] or 0
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return 0
        raise


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    version = current_version(spark, path)
    return spark.read.parquet(f"{path}/v{version}") if version else None


def write_version(df: DataFrame, path: str) -> int:
    """Write the next version, then move the pointer: readers never see half a table."""
    spark = df.sparkSession
    version = current_version(spark, path) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{version}")
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{path}/current")
    return version


def merge_partials(old: DataFrame | None, new: DataFrame, keys: list[str], sums: list[str], latest: list[str]) -> DataFrame:
    """Add increments to stored totals (never replace them)."""
    both = new.select(*keys, *sums, *latest)
    if old is not None:
        both = old.select(*both.columns).unionByName(both)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in latest])


#: Buckets of a totals store.
BUCKETS = 64
_BUCKET = "_bucket"


def _pointer(spark: SparkSession, path: str) -> tuple[int, int]:
    """(version, last batch) that a totals store names; (0, -1) before the first write."""
    try:
        row = spark.read.parquet(f"{path}/pointer").agg(F.max(F.struct("version", "batch")).alias("p")).first()["p"]
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return 0, -1
        raise
    return (row["version"], row["batch"]) if row else (0, -1)


def _places(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """The version that wrote each bucket last: one row for each bucket."""
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/places/v{version}").collect()} if version else {}


def _read_places(spark: SparkSession, path: str, places: dict[int, int]) -> DataFrame | None:
    folders = [f"{path}/data/v{version}/{_BUCKET}={bucket}" for bucket, version in sorted(places.items())]
    return spark.read.parquet(*folders) if folders else None


def read_totals(spark: SparkSession, path: str) -> DataFrame | None:
    """All totals of a store, each bucket from the version that wrote it last."""
    return _read_places(spark, path, _places(spark, path, _pointer(spark, path)[0]))


def add_to_totals(
    spark: SparkSession, path: str, increment: DataFrame, keys: list[str], sums: list[str], latest: list[str], batch: int, buckets: int = BUCKETS,
) -> list[int]:
    """Add an increment to stored totals; only buckets of its keys are read and written again (returned).

    A version is a folder with the buckets it changed and a list that says where each bucket lies; moving the pointer
    ends a write. A batch whose number is not above the last one changes nothing, and one that failed halfway writes
    the same folder again.
    """
    version, last = _pointer(spark, path)
    if batch <= last:
        return []
    columns = [*keys, *sums, *latest]
    rows = increment.select(*columns, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(_BUCKET))
    places = _places(spark, path, version)
    # at most as many values as there are buckets
    touched = sorted(r[0] for r in rows.select(_BUCKET).distinct().collect())
    old = _read_places(spark, path, {b: places[b] for b in touched if b in places})
    merged = merge_partials(old, rows, keys, sums, latest)
    merged = merged.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    merged.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/data/v{version + 1}")
    now = {**places, **dict.fromkeys(touched, version + 1)}
    spark.createDataFrame(list(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/places/v{version + 1}")
    spark.createDataFrame([(version + 1, batch)], "version int, batch int").coalesce(1).write.mode("append").parquet(f"{path}/pointer")
    return touched


def moved_similarity(pairs: DataFrame, before: DataFrame, after: DataFrame, entity: str, opponent: str) -> DataFrame:
    """What changed profiles move between groups: pair totals leave the old value and enter the new one."""
    groups = {"handedness": "handedness", "velocity": "velocity_tier"}
    old = before.select(opponent, *[F.col(c).alias(f"_old_{c}") for c in groups.values()])
    differs = [~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in groups.values()]
    changed = after.select(opponent, *groups.values()).join(old, opponent).where(differs[0] | differs[1])
    sides = F.array(*[
        F.when(~F.col(c).eqNullSafe(F.col(f"_old_{c}")), F.struct(F.lit(kind).alias("group_type"), F.col(name).alias("group_value"), F.lit(sign).alias("sign")))
        for kind, c in groups.items() for name, sign in ((f"_old_{c}", -1), (c, 1))])
    moves = pairs.join(changed, opponent).select(entity, "pa", "hr", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("g"))
    return moves.groupBy(entity, F.col("g.group_type").alias("group_type"), F.col("g.group_value").alias("group_value")).agg(
        F.sum(F.col("pa") * F.col("g.sign")).alias("pa"), F.sum(F.col("hr") * F.col("g.sign")).alias("hr"))


def replace_rows(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key, for tables that are recomputed per key (profiles)."""
    return new if old is None else old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def matchup_increment(events: DataFrame, entity: str, opponent: str, day: str, attempt: str, hit: str, impact: str, angle: str) -> DataFrame:
    """Mergeable pair totals of a batch of events."""
    return events.groupBy(entity, opponent).agg(
        F.sum(attempt).alias("pa"), F.sum(hit).alias("hr"), F.sum(impact).alias("ev_sum"), F.count(impact).alias("ev_n"),
        F.sum(angle).alias("la_sum"), F.count(angle).alias("la_n"), F.count(F.lit(1)).alias("rows"), F.max(day).alias("last_date"))


def upsert_matchup_tables(
    spark: SparkSession, path: str, increment: DataFrame, profiles: DataFrame, similarity: DataFrame, entity: str, opponent: str,
) -> None:
    """The pair, profile and similarity tables and a metadata row.

    ``similarity`` are the batch's totals under the new profiles; what earlier batches added under profiles that have
    changed since moves to the new groups. The profiles, which several of the writes read, are written once before.
    """
    profiles = materialise(profiles)
    stored, known = read_version(spark, f"{path}/matchups"), read_version(spark, f"{path}/profiles")
    keys = [entity, "group_type", "group_value"]
    if stored is not None and known is not None:
        similarity = similarity.select(*keys, "pa", "hr").unionByName(moved_similarity(stored, known, profiles, entity, opponent))
    merged = merge_partials(read_version(spark, f"{path}/similarity"), similarity, keys, ["pa", "hr"], []).where("pa <> 0 or hr <> 0")
    write_version(merged.withColumn("hr_rate", F.col("hr") / F.greatest(F.col("pa"), F.lit(1))), f"{path}/similarity")
    pairs = merge_partials(stored, increment, [entity, opponent], PAIR_SUMS, ["last_date"])
    write_version(pairs, f"{path}/matchups")
    write_version(replace_rows(known, profiles, [opponent]), f"{path}/profiles")
    written = read_version(spark, f"{path}/matchups")
    write_version(written.agg(F.count(F.lit(1)).alias("pairs"), F.max("last_date").alias("last_date")), f"{path}/metadata")


def game_id(date: str, home: str, away: str) -> Column:
    """``date_home_away``."""
    return F.concat_ws("_", F.date_format(date, "yyyy-MM-dd"), home, away)


def insert_or_ignore(existing: DataFrame | None, rows: DataFrame, keys: list[str], named: str | None = None) -> DataFrame:
    """One row per key, only keys the table does not hold yet; rows with an empty ``named`` column are left out."""
    kept = rows if named is None else rows.where(F.length(F.trim(F.coalesce(F.col(named), F.lit("")))) > 0)
    rest = [c for c in kept.columns if c not in keys]
    single = kept.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else kept.select(*keys).distinct()
    return single if existing is None else single.join(existing.select(*keys), keys, "left_anti")
