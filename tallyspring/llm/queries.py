"""The registered queries: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspring.llm import langid
from tallyspring.llm.bpe_automaton import round_trip
from tallyspring.llm.chat import digests, format_conversations
from tallyspring.llm.filter_audit import audit
from tallyspring.llm.hard_negatives import mine
from tallyspring.llm.minhash import near_duplicates
from tallyspring.llm.mixing import mix
from tallyspring.llm.oracles import ORACLES
from tallyspring.llm.packing import pack
from tallyspring.llm.quality import quality
from tallyspring.llm.secrets import scan
from tallyspring.llm.token_count import count_tokens
from tallyspring.llm.url_filter import judge
from tallyspring.llm.vector_dedup import link_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned_from = ~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))
    model = langid.train(documents.filter(learned_from), id_col="doc_id", text_col="text", lang_col="lang")
    out = langid.identify(documents.select("doc_id", "text"), model)
    return out.select("row.doc_id", F.coalesce(langid.held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2, numPartitions=1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    return digests(format_conversations(rows.unionByName(extra)))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_secret_scan": op4_secret_scan,
    "op5_mixing": op5_mixing,
    "op6_vector_dedup": op6_vector_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_bpe_automaton": op13_bpe_automaton,
}

__all__ = ["ORACLES", "QUERIES"]
