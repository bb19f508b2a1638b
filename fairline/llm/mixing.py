"""Mixing sources to target weights by Pareto order sampling.

Sources share the corpus' words by weight, each target stopped at ``most`` times its source. Within a source a document
expects a number of copies that grows with the bit length of its size; the whole part is certain, the fractional part
is the inclusion probability p of one more copy. Documents are ranked by (u / (1 - u)) / (p / (1 - p)) with u derived
from the document id, and the leading ones are taken until the words that certain copies leave open are filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.durable import materialise
from fairline.functions.ordering import running_totals
from fairline.llm.text import WORD

#: Weights of the sources in code point order, repeated.
WEIGHTS = (1.0, 2.0, 3.0)
#: Copies of a document at most, and so words of a source in the mix per word it has.
MOST = 3
SEED = "mix"


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from ``source`` and ``size``; one row per source, null among them.

    Capped sources come first in the order of cap by weight, so a running total replaces repeated resharing. The
    windows run over the table of sources, not of documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") - 1) % len(weights) + 1)
    w = by_source.withColumn("_n", F.row_number().over(order)).withColumn("_w", weight)
    ranked = Window.orderBy(F.col("source_size") / F.col("_w"), "_n")
    before, onward = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    open_words = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = w.withColumn("_level", open_words / F.sum("_w").over(onward)).withColumn("_place", F.row_number().over(ranked))
    fits = F.when(F.col("_level") * F.col("_w") <= most * F.col("source_size"), F.struct("_place", "_level"))
    return level.withColumn("_f", F.min(fits).over(every)).select(
        "source",
        "source_size",
        F.when(F.col("_place") >= F.col("_f._place"), F.col("_f._level") * F.col("_w"))
        .otherwise((most * F.col("source_size")).cast("double"))
        .alias("target"),
    )


def _expected(classes: DataFrame, most: int) -> DataFrame:
    """Expected copies by (source, size class): min(most, c * class), c such that expected words meet the target."""
    ranked = Window.partitionBy("_key").orderBy(F.col("class").desc())
    before, onward = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    open_words = F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))
    fits = F.when(F.col("_c") * F.col("class") <= most, F.struct("_place", "_c"))
    scaled = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col("_f._c") * F.col("class")))
    return (
        classes.where(F.col("words") > 0)
        .withColumn("_c", open_words / F.sum(F.col("class") * F.col("words")).over(onward))
        .withColumn("_place", F.row_number().over(ranked))
        .withColumn("_f", F.min(fits).over(Window.partitionBy("_key")))
        .withColumn("_e", F.when(F.col("_place") >= F.col("_f._place"), scaled).otherwise(F.lit(float(most))))
        .select("_key", "class", F.floor("_e").alias("whole"), (F.col("_e") - F.floor("_e")).alias("p"))
    )


def _rank(seed: str) -> Column:
    """Random odds by inclusion odds, then id and text hash; null where no further copy is open."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("_id", F.lit("")))), 1, 12), 16, 10).cast("double")
    u = (drawn + 0.5) / float(16**12)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    return F.when(F.col("p") > 0, F.struct(odds.alias("odds"), F.coalesce("_id", F.lit("")).alias("id"), F.col("_hash").alias("hash")))


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: list[str] | None = None,
    most: int = MOST, weights: tuple[float, ...] = WEIGHTS, seed: str = SEED,
) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (= copies * size).

    Null texts and texts without words have size 0 and no copies. A null source is a source of its own, last in order.
    Rows that tie on id are told apart by the text's hash; full repeats are taken together. An empty table gives an
    empty result. ``carry`` names columns to return along (all by default); clashing names are left out.

    Only (source, rank, size) rows are sorted, a large source over many range partitions. The sample is told by its
    last rank, so documents are joined with one row per source and size class only. If the open words aren't filled
    exactly, the untaken document whose size is nearest to the rest is added where that brings the source nearer.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    rest = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added and not c.startswith("_")]
    size = size_in_words(F.col(text))
    sized = materialise(docs.select(
        *rest, F.col(source).cast("string").alias("_source"), F.col(doc_id).cast("string").alias("_id"),
        F.xxhash64(text).alias("_hash"), size.alias("_size"),
    ).withColumn("_key", F.coalesce(F.concat(F.lit("="), "_source"), F.lit("-")))
     .withColumn("class", F.length(F.bin("_size")).cast("long")))
    by_class = sized.groupBy("_key", "class").agg(F.first("_source").alias("source"), F.sum("_size").alias("words"))
    by_class = materialise(by_class)
    targets = source_targets(by_class.withColumnRenamed("words", "size"), most, weights)
    targets = materialise(targets.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("_key"), "source_size", "target"))
    expected = materialise(_expected(by_class.join(targets, "_key"), most))
    drawn = sized.join(expected, ["_key", "class"]).withColumn("rank", _rank(seed))
    certain = drawn.groupBy("_key").agg(F.sum(F.col("whole") * F.col("_size")).alias("certain"))
    open_words = materialise(
        targets.join(certain, "_key", "left").select("_key", (F.col("target") - F.coalesce("certain", F.lit(0))).alias("open"))
    )
    ranked = drawn.where(F.col("rank").isNotNull()).groupBy("_key", "rank").agg(F.sum("_size").alias("words"))
    totals = materialise(running_totals(ranked, ["_key"], ["rank"], ["words"]).join(open_words, "_key"))
    leads = F.col("words_before") + F.col("words") <= F.col("open")
    cut = totals.where(leads).groupBy("_key").agg(F.max("rank").alias("last"), F.sum("words").alias("led"))
    gap = materialise(open_words.join(cut, "_key", "left").select("_key", "last", (F.col("open") - F.coalesce("led", F.lit(0))).alias("gap")))
    off = F.abs(F.col("words") - F.col("gap"))
    closing = (
        totals.where(~leads).join(gap, "_key").where(off < F.col("gap"))
        .groupBy("_key").agg(F.min(F.struct(off.alias("off"), F.col("rank").alias("rank")))["rank"].alias("closing"))
    )
    cuts = materialise(targets.join(gap.drop("gap"), "_key").join(closing, "_key", "left"))
    more = F.coalesce(F.col("rank") <= F.col("last"), F.lit(False)) | F.coalesce(F.col("rank") == F.col("closing"), F.lit(False))
    out = sized.join(expected, ["_key", "class"], "left").withColumn("rank", _rank(seed)).join(cuts, "_key")
    copies = (F.coalesce("whole", F.lit(0)) + F.when(more, 1).otherwise(0)).cast("long")
    return out.select(*rest, F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken"))
