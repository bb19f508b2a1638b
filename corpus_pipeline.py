"""From documents to a training mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions.durable import materialise
from fairline.llm.decontamination import rows_without_items
from fairline.llm.mixing import mix
from fairline.llm.near_duplicates import near_duplicates
from fairline.llm.personal import personal_data, redacted
from fairline.llm.quality import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't outliers of their language and source."""
    return quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates; one of rows that are repeated in full.

    Null texts and texts without words are in no class and stay.
    """
    # null differs from every value; ids come first, so that the smallest key has the smallest id
    rest = [F.coalesce(F.concat(F.lit("="), F.md5(F.col(c).cast("string"))), F.lit("-")) for c in COLUMNS[1:]]
    own = F.concat(F.lpad(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), 20, "0"), *rest)
    keyed = docs.select(*COLUMNS, own.alias("_key"))
    classes = near_duplicates(keyed, "text", "_key").select(F.col("class_id").alias("_key")).distinct()
    return keyed.join(classes, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return rows_without_items(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and lengths counted anew."""
    found = personal_data(docs.select(*COLUMNS), carry=COLUMNS)
    text = F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    clean = found.withColumn("text", text)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies and of words taken."""
    return mix(docs, carry=COLUMNS).where("copies > 0")


STAGES = [
    ("quality rules", quality),
    ("near duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("personal data", without_personal_data),
    ("mixing", mixed),
]

#: Edit distances, the graph of near duplicates and the bootstrapped patterns have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
