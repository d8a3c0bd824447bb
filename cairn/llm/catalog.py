"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.runtime import ship

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.chat import chat_digests, format_chats

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(1).selectExpr("explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) AS t")
    extra = extra.select(F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").alias("turn"), F.col("t.role").alias("role"), F.lit(said).alias("text"))
    return chat_digests(format_chats(rows.unionByName(extra)))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.urls import demonstration_captures, demonstration_entries, filter_captures

    pages = _table(spark, sf_dir, "pages")
    return filter_captures(demonstration_captures(pages), demonstration_entries(pages))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.pii import detect

    return detect(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.toxicity import assess

    return assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.quality import assess

    return assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.lexical import rank_documents

    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.wrappers import main_texts

    return main_texts(_table(spark, sf_dir, "pages"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_chat, op3_url_filter, op4_pii, op5_toxicity, op6_packing, op7_bpe, op8_quality, op9_licenses, op10_topk, op11_lexical, op12_html, op13_divergence)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from cairn.llm.oracles import ORACLES

    return dict(ORACLES)
