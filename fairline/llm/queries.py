"""One query per operator over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.alignment import align
from fairline.llm.conversations import damaged, repair_conversations
from fairline.llm.decontamination import contaminations
from fairline.llm.language import language_id
from fairline.llm.licenses import license_scan
from fairline.llm.mixing import mix
from fairline.llm.near_duplicates import near_duplicates
from fairline.llm.personal import KINDS, count_of, personal_data, written_spans
from fairline.llm.quality import quality_rules
from fairline.llm.registry import QUERIES, documents, query  # noqa: F401  (QUERIES is what this module fills)
from fairline.llm.substrings import without_repeats
from fairline.llm.suffix_tree import score_texts
from fairline.llm.token_counts import token_counts
from fairline.llm.twins import CONVERSATIONS, MIXING, WINDOWS, quality_sql
from fairline.llm.windows import without_repeated_windows


@query("op10_quality_rules", quality_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir), carry=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op1_pareto_mixing", MIXING)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir), carry=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op9_suffix_tree_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir), carry=["doc_id"])


@query("op3_edit_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir), carry=["doc_id"])


@query("op7_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


@query("op6_repeated_substrings")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))


@query("op4_personal_data")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir), carry=["doc_id"])
    counts = [count_of(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans")
    )


@query("op13_window_dedup", WINDOWS)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_windows(documents(spark, sf_dir)).drop("removed")


@query("op12_conversation_repair", CONVERSATIONS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_conversations(damaged(turns), "conv", of=turns.select(F.col("conv_id").alias("conv"))).withColumnRenamed("conv", "conv_id")


@query("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
