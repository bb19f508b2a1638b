"""Reading and writing event, dataset, weather and snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline import schema
from fairline.operators.clean import derive_event_flags, filter_regular_season, normalise_dates, require_columns
from fairline.operators.join import WEATHER_DEFAULTS


def read_pitch_events(
    spark: SparkSession, path: str, first: str | None = None, last: str | None = None, kind: str = "parquet",
) -> DataFrame:
    """Required and optional event columns (absent optional ones as typed nulls), flags, regular season only.

    The date range is a filter on the source column, so it prunes partitions
    and row groups.
    """
    required, optional = schema.fields(schema.EVENT_REQUIRED), schema.fields(schema.EVENT_OPTIONAL)
    if kind == "csv":
        raw = spark.read.csv(path, header=True)
    else:
        raw = spark.read.format(kind).load(path)
    require_columns(raw, [n for n, _ in required])
    # a typed date column keeps the filter pushed to the source; text is tried, so a bad date drops its row only
    day = F.col("game_date") if raw.schema["game_date"].dataType.typeName() in ("date", "timestamp") else F.col("game_date").try_cast("date")
    if first:
        raw = raw.where(day >= F.lit(first).cast("date"))
    if last:
        raw = raw.where(day <= F.lit(last).cast("date"))
    typed = raw.select(*[
        (F.col(n).try_cast(t) if n in raw.columns else F.lit(None).cast(t)).alias(n) for n, t in [*required, *optional]])
    return normalise_dates(derive_event_flags(filter_regular_season(typed)))


def save_dataset(df: DataFrame, folder: str, name: str, kind: str = "parquet", partition: str | None = "season") -> str:
    """Write a dataset under its id, partitioned by season where it has one."""
    path = f"{folder}/{name}.{kind}"
    writer = df.write.mode("overwrite")
    if partition and partition in df.columns:
        writer = writer.partitionBy(partition)
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(kind).save(path)
    return path


def load_dataset(spark: SparkSession, folder: str, name: str, kind: str = "parquet", ddl: str | None = None, date: str = "date") -> DataFrame:
    """Read it back; CSV dates are parsed again."""
    path = f"{folder}/{name}.{kind}"
    if kind == "csv":
        reader = spark.read.option("header", True)
        df = (reader.schema(ddl) if ddl else reader).csv(path)
        return df.withColumn(date, F.to_date(date)) if date in df.columns else df
    return spark.read.format(kind).load(path)


def read_weather_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: the weather side table with a fixed schema."""
    return spark.read.csv(path, header=True, schema=schema.WEATHER)


def attach_weather_csv(games: DataFrame, weather: DataFrame | None) -> DataFrame:
    """S3: left join on (date, stadium); without a table, null columns."""
    if weather is None:
        return games.withColumns({c: F.lit(None).cast("double") for c in WEATHER_DEFAULTS})
    return games.join(weather, ["date", "stadium"], "left")


def read_dataset_union(spark: SparkSession, pattern: str, keys: list[str] | None = None, skip_unreadable: bool = False) -> DataFrame:
    """All snapshots with the union of their columns.

    An unreadable file is an error unless ``skip_unreadable`` is set; ``skipped_files`` then tells which. With
    ``keys``, overlapping snapshots keep the row of the newest file (by name), of equal ones the largest row; the
    choice is a mergeable aggregate, not a sort.
    """
    rows = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", skip_unreadable).parquet(pattern)
    if not keys:
        return rows
    tagged = rows.withColumn("_file", F.col("_metadata.file_path"))
    rest = [c for c in rows.columns if c not in keys]
    newest = tagged.groupBy(*keys).agg(F.max(F.struct(F.col("_file"), *rest)).alias("_r"))
    return newest.select(*keys, "_r.*").select(*rows.columns)


def skipped_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Files of the pattern that give no row when unreadable ones are skipped (column ``path``)."""
    there = spark.read.format("binaryFile").load(pattern).select("path")
    read = spark.read.option("ignoreCorruptFiles", True).parquet(pattern).select(F.col("_metadata.file_path").alias("path")).distinct()
    return there.join(read, "path", "left_anti")


def write_snapshot(df: DataFrame, folder: str, name: str, date: str) -> tuple[str, str]:
    """A dated snapshot and the ``latest`` copy, both snappy; the copy re-reads the snapshot."""
    dated, latest = f"{folder}/{name}_{date}.parquet", f"{folder}/{name}_latest.parquet"
    df.write.mode("overwrite").option("compression", "snappy").parquet(dated)
    df.sparkSession.read.parquet(dated).write.mode("overwrite").option("compression", "snappy").parquet(latest)
    return dated, latest


def export_ledger_csv(bets: DataFrame, path: str, day: str = "date", stamp: str = "timestamp") -> None:
    """The ledger, newest first, as CSV part files in global order."""
    bets.orderBy(F.desc(day), F.desc(stamp)).write.mode("overwrite").option("header", True).csv(path)


def export_sample(df: DataFrame, path: str, rows: int = 1000, seed: int = 42, keys: list[str] | None = None) -> None:
    """A fixed-size sample that a seed reproduces: the rows with the smallest hash of their key."""
    order = F.xxhash64(F.lit(seed), *[F.col(c) for c in (keys or df.columns)])
    df.orderBy(order).limit(rows).write.mode("overwrite").option("header", True).csv(path)


def export_recent_json(events: DataFrame, path: str, ts: str, hours: int) -> None:
    """Recent events as JSON lines."""
    from fairline.operators.monitor import since_hours

    since_hours(events, ts, hours).write.mode("overwrite").json(path)
