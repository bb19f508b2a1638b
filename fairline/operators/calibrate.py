"""Isotonic calibration by distributed pooling of adjacent violators.

Scores are counted first. Counted scores are cut into ranges; each task pools the violators of its range as one stream,
and what is left are blocks of rising rates. Neighbouring ranges are then joined in pairs, twice as many each round: only
blocks whose rates overlap with the other side's can pool further, so only those meet in a task; all others stay where
they are. Rounds end when no neighbours overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.durable import materialise
from fairline.functions.ordering import running_totals

SURE = 1e-6
_BLOCK = "slice int, low double, high double, n long, pos double"


def _pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of rising rates from rows sorted by (slice, low); a pool is a block's only state."""
    blocks: list[list] = []
    now = None

    def out() -> pd.DataFrame:
        return pd.DataFrame([[now, *b] for b in blocks], columns=["slice", "low", "high", "n", "pos"])

    for batch in batches:
        for cut, low, high, n, pos in batch[["slice", "low", "high", "n", "pos"]].itertuples(index=False):
            if cut != now:
                if blocks:
                    yield out()
                blocks, now = [], cut
            block = [low, high, n, pos]
            while blocks and blocks[-1][3] * block[2] >= block[3] * blocks[-1][2]:
                before = blocks.pop()
                block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
            blocks.append(block)
    if blocks:
        yield out()


def _pool(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions("slice", "low").mapInPandas(_pooled, _BLOCK)


def fit_isotonic(df: DataFrame, p: str, label: str, slices: int | None = None) -> DataFrame:
    """Blocks (``low``, ``high``, ``n``, ``value``) of the isotonic regression of the label on the score.

    Equal scores are one point. Rows without score or label don't count. Few distinct scores give few blocks; nothing is
    skipped (``distinct_scores`` tells how many there are, for callers with a rule of their own). No rows give no blocks.
    """
    spark = df.sparkSession
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = df.select(F.col(p).cast("double").alias("low"), F.col(label).cast("double").alias("y")).where("low is not null and not isnan(low) and y is not null")
    points = materialise(known.groupBy("low").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")))
    ranged = points.repartitionByRange(count, "low").select(
        F.spark_partition_id().cast("int").alias("slice"), "low", F.col("low").alias("high"), "n", "pos")
    blocks = materialise(_pool(ranged))
    rate = F.col("pos") / F.col("n")
    while True:
        # one row for each slice; a slice overlaps its left neighbour if its least rate isn't above that one's highest
        ends = blocks.groupBy("slice").agg(F.min(rate).alias("least"), F.max(rate).alias("most"))
        order = Window.partitionBy(F.lit(0)).orderBy("slice")
        if ends.withColumn("before", F.lag("most").over(order)).where("least <= before").isEmpty():
            break
        # pairs of neighbours (by rank, so slices without scores don't count); the overlap of rates is what can pool
        pairs = ends.withColumn("_rank", F.row_number().over(order) - 1).withColumn("pair", F.floor(F.col("_rank") / 2).cast("int"))
        side = Window.partitionBy("pair").orderBy("slice")
        bounds = pairs.select(
            "slice", "pair", F.lag("most").over(side).alias("left_most"), F.lead("least").over(side).alias("right_least"))
        placed = blocks.join(F.broadcast(bounds), "slice")
        meets = F.coalesce(rate >= F.col("right_least"), F.lit(False)) | F.coalesce(rate <= F.col("left_most"), F.lit(False))
        placed = placed.select(F.col("pair").alias("slice"), "low", "high", "n", "pos", meets.alias("meets"))
        still = placed.where(~F.col("meets")).drop("meets")
        blocks = materialise(still.unionByName(_pool(placed.where("meets").drop("meets").repartition("slice"))))
    return blocks.select("low", "high", "n", (F.col("pos") / F.col("n")).alias("value"))


def distinct_scores(df: DataFrame, p: str, decimals: int = 3) -> int:
    """Distinct scores at some decimals: too few make a calibration meaningless."""
    return df.select(F.round(p, decimals)).distinct().count()


def apply_isotonic(blocks: DataFrame, df: DataFrame, p: str, out: str = "calibrated") -> DataFrame:
    """Calibrated scores within (0, 1): a block's value inside it, straight lines between blocks, flat beyond the ends.

    Distinct scores and blocks are ordered together over ranges; the number of blocks that begin at or before a score is
    the block's own number, so look-ups are equi joins. Null scores stay null; without blocks scores pass through.
    """
    spots = df.select(F.col(p).cast("double").alias("x")).where("x is not null").distinct().withColumn("is_block", F.lit(0))
    starts = blocks.select(F.col("low").alias("x"), F.lit(1).alias("is_block"), "high", "value")
    # at equal places the block comes first
    counted = materialise(running_totals(
        spots.unionByName(starts, allowMissingColumns=True).withColumn("_after", 1 - F.col("is_block")), [], ["x", "_after"], ["is_block"]))
    numbered = counted.where("is_block = 1").select(
        (F.col("is_block_before") + 1).alias("k"), F.col("x").alias("low"), "high", "value")
    own = numbered.select("k", F.col("high").alias("_high"), F.col("value").alias("_value"))
    next_ = numbered.select((F.col("k") - 1).alias("k"), F.col("low").alias("_next"), F.col("value").alias("_next_value"))
    asked = counted.where("is_block = 0").select("x", F.col("is_block_before").alias("k"))
    found = asked.join(own, "k", "left").join(next_, "k", "left")
    between = F.col("_value") + (F.col("_next_value") - F.col("_value")) * (F.col("x") - F.col("_high")) / (F.col("_next") - F.col("_high"))
    value = (
        F.when(F.col("_value").isNull(), F.coalesce("_next_value", "x")).when(F.col("_next").isNull() | (F.col("x") <= F.col("_high")), F.col("_value"))
        .otherwise(between)
    )
    rated = found.select(F.col("x").alias("_x"), F.least(F.greatest(value, F.lit(SURE)), F.lit(1 - SURE)).alias(out))
    kept = [c for c in df.columns if c != out]
    return df.select(*kept, F.col(p).cast("double").alias("_x")).join(rated, "_x", "left").select(*kept, out)
