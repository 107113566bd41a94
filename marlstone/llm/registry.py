"""The queries of this subpackage: thin applications of its operators to whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, embeddings, html_text, lm, mixing, oracles, pieces, quality, setsketch, sharding, url_tree
from .common import read

#: Rules (verdict, host, path), in the order given (fixed values).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(read(spark, sf_dir, "embeddings"), least=0.93)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.digests(chat_format.format_chats(rows.unionByName(extra)))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(read(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


def op7_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(read(spark, sf_dir, "documents"), n=2, percent=80)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(mixing.mixed(read(spark, sf_dir, "documents")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"), pieces.PieceModel.load(pieces.DEFAULT_MODEL))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_tree.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {
    "op1_pigeonhole": op1_pigeonhole,
    "op2_chat_format": op2_chat_format,
    "op3_sharding": op3_sharding,
    "op4_quality_rules": op4_quality_rules,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_html_text": op6_html_text,
    "op7_setsketch": op7_setsketch,
    "op8_mixing": op8_mixing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_url_filter": op10_url_filter,
}

#: The others depend on hashes, learnt models, parsers or packing; tests/llm compares them with plain versions.
ORACLES: dict[str, str] = {"op1_pigeonhole": oracles.OP1, "op2_chat_format": oracles.op2(), "op7_setsketch": oracles.OP7}
