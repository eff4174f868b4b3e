"""The registered queries of the subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptscore.llm import byte_bpe, contamination, conversation_repair, hard_negatives, line_frequency, main_text, pu_quality, repeats, simhash, sql, token_records, transcripts, unit_dedup, warc
from promptscore.llm.words import table
from promptscore.session import new_work_dir


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality_rules(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"), new_work_dir(spark, "op2"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(spark, table(spark, sf_dir, "documents"), new_work_dir(spark, "op3"))
    sizes = F.transform("removed", lambda s: s["end"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        F.aggregate(sizes, F.lit(0).cast("long"), lambda total, n: total + n).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = unit_dedup.dedup_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return cut.select(
        "doc_id", "text", F.size("removed_spans").cast("long").alias("n_removed"), F.array_join(spans, ",").alias("removed")
    )


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_work_dir(spark, "op5")
    encoder = spark.sparkContext.broadcast(token_records.StretchEncoder(public_tokenizers.path("word_bpe_49k.json")))
    manifest = token_records.write_records(spark, table(spark, sf_dir, "documents"), encoder, root)
    return token_records.read_records(spark, root, manifest)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = main_text.extract(spark, table(spark, sf_dir, "pages"), new_work_dir(spark, "op6"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return pu_quality.quality_scores(spark, docs, labels, new_work_dir(spark, "op7"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coder = byte_bpe.coder(spark, path, public_tokenizers.PATTERN)
    return byte_bpe.round_trips(table(spark, sf_dir, "documents"), coder)


def op9_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = transcripts.sections(table(spark, sf_dir, "conversations"))
    return transcripts.format_sections(turns, transcripts.learn(turns))


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark, table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark, table(spark, sf_dir, "pages"), new_work_dir(spark, "op13"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_frequency": op1_line_frequency,
        "op2_simhash": op2_simhash,
        "op3_repeats": op3_repeats,
        "op4_unit_dedup": op4_unit_dedup,
        "op5_token_records": op5_token_records,
        "op6_main_text": op6_main_text,
        "op7_pu_quality": op7_pu_quality,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_transcripts": op9_transcripts,
        "op10_contamination": op10_contamination,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_warc": op13_warc,
    }


def all_oracles() -> dict[str, str]:
    return {"op1_line_frequency": sql.OP1, "op4_unit_dedup": sql.OP4, "op10_contamination": sql.OP10, "op11_hard_negatives": sql.OP11, "op13_warc": sql.OP13}
