"""From raw documents to packed training sequences, as stages that each apply one operator of ``tallyspring.llm``.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspring.llm import langid
from tallyspring.llm.minhash import near_duplicates, text_key
from tallyspring.llm.mixing import mix
from tallyspring.llm.packing import pack
from tallyspring.llm.secrets import scan
from tallyspring.llm.storage import shared_folder
from tallyspring.llm.words import whole_rows

#: A document whose main language has a smaller share of its letters is rejected.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, or without a main one; fills a missing lang with the prediction."""
    model = langid.train(docs, id_col="doc_id", text_col="text", lang_col="lang")
    told = langid.identify(docs, model).filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return told.select(*(F.coalesce("row.lang", "lang_pred").alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, and one of rows that repeat. Documents without an id stay.

    Rows with one id and different texts are different documents.
    """
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    keyed = whole_rows(docs).select("row", F.col("row.doc_id").alias("id"), text_key(F.col("row.text")).alias("key"))
    named = keyed.join(kept, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return named.select("row.*").unionByName(docs.filter("doc_id IS NULL"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of each secret; no document goes."""
    told = scan(docs, redact=True)
    new = {"text": F.when(F.col("spans") == "", F.col("row.text")).otherwise(F.col("redacted")), "n_chars": F.when(F.col("spans") == "", F.col("row.n_chars")).otherwise(F.length("redacted").cast("long"))}
    return told.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources come near their targets; a part of a copy is rounded.

    Rows with one id and different texts are different documents. Rows that repeat get the same number of copies.
    """
    keyed = whole_rows(docs).select("row", F.concat_ws(":", "row.doc_id", text_key(F.col("row.text"))).alias("key"), "row.text", "row.source")
    copies = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    taken = mix(keyed, id_col="key").groupBy("key", "source").agg(F.max(copies).alias("copies")).filter("copies > 0")
    taken = taken.select(F.col("key").alias("key2"), F.col("source").alias("source2"), "copies")
    mixed = keyed.join(taken, (F.col("key") == F.col("key2")) & F.col("source").eqNullSafe(F.col("source2")))
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing), ("packing", packing)]

#: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage returns is written, and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
