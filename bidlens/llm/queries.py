"""Queries over the dealt operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.llm import (bpe, chat, exact_dedup, hmm, near_dedup, packing, pii, prefix_trie, quality, sharding, topk,
                         vector_codes, warc)
from bidlens.llm.tables import read
from bidlens.session import new_table_path

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_sharding(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents stored in 64 shards by id and read back: doc_id, slot, shard and the text's length in bytes."""
    stored = sharding.write_shards(read(spark, d, "documents"), new_table_path(spark, "shards"), ["doc_id"], SHARDS)
    return stored.select("doc_id", F.octet_length("text").alias("text_bytes"), "slot", "shard")


def word_file() -> str:
    """The tokenizer file, as the installed package of public tokenizers places it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.round_trip_digests(read(spark, d, "documents"), word_file())


def op3_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"), word_file())


def op4_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, d, "documents"))


def op5_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.score(read(spark, d, "documents"), read(spark, d, "labels"))


def op6_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.near_groups(read(spark, d, "documents"))


def op7_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(read(spark, d, "embeddings"), F.col("id") % 20 == 0, k=20)


def op8_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.report(read(spark, d, "documents"))


CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, d: str) -> DataFrame:
    """All conversations, as logs of attempts, deltas and edits, and one, number -7, whose texts hold the template's control strings."""
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.format_and_read_back(chat.streamed_events(rows))


def op10_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.archive_pages(read(spark, d, "pages"))


def op11_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, d, "conversations"))


def op12_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return hmm.score(read(spark, d, "documents"))


def op13_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    return vector_codes.compress(read(spark, d, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_bpe, op3_packing, op4_exact_dedup, op5_quality, op6_near_dedup, op7_topk, op8_pii, op9_chat,
    op10_warc, op11_prefix_trie, op12_lm_scoring, op13_vector_codes)}
