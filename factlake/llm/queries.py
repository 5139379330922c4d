"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import (bpe, chat_format, exact_dedup, langid, line_dedup, near_dup, packing, secrets, spelling, suffix_dedup, topk,
                          toxicity, whitening)
from factlake.llm.common import held_out
from factlake.sources.tables import table


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    return (toxicity.score(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted"))


def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_decode_digest(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                    public_tokenizers.PATTERN)


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.removed_digest(table(spark, sf, "documents"))


def op6_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf, "documents"))


def op7_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), k=5, query_every=50)


def op8_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan_digest(table(spark, sf, "documents"))


def op9_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf, "documents"), percent=85).drop("text_hash")


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return langid.predict(docs, langid.fit(docs))


CHAT_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CHAT_TURNS, "conv_id long, turn long, role string, text string")
    return chat_format.conversation_digests(chat_format.format_conversations(turns.unionByName(more)))


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf, "documents"), drop_every=97)


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"), 16)


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_bpe, op3_line_dedup, op4_best_fit_packing, op5_suffix_dedup, op6_exact_dedup, op7_topk, op8_secret_scan, op9_near_dup, op10_language_id,
    op11_chat_format, op12_spelling_variants, op13_whitening)}


def oracle_sql() -> dict:
    return {"op6_exact_dedup": exact_dedup.SQL, "op7_topk": topk.SQL, "op9_near_dup": near_dup.SQL, "op11_chat_format": chat_format.SQL}
