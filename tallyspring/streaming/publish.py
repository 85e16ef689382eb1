"""Summary messages: rows of topic, key and JSON value, for any sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER_TOPIC, TRANSACTION_TOPIC = "stream:ledgers", "stream:transactions"


def ledger_messages(ledgers: DataFrame) -> DataFrame:
    """One object for each ledger."""
    closed = F.date_format("closed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("closed_at")
    value = F.to_json(F.struct("sequence", "hash", closed, "transaction_count", "operation_count", "protocol_version"))
    return ledgers.select(F.lit(LEDGER_TOPIC).alias("topic"), F.col("sequence").cast("string").alias("key"), value.alias("value"))


def json_arrays(df: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, value): the rows of each key as one JSON array, ordered by all of ``order``."""
    rows = F.sort_array(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*fields).alias("row"))))
    return df.groupBy(F.col(key).alias("key")).agg(F.to_json(F.transform(rows, lambda r: r["row"])).alias("value"))


def transaction_messages(transactions: DataFrame) -> DataFrame:
    """One array for each ledger that has transactions; nothing for others."""
    fields = ["hash", "ledger_sequence", "account", "operation_count", "status", "is_soroban"]
    arrays = json_arrays(transactions, "ledger_sequence", ["application_order", "hash"], fields)
    return arrays.select(F.lit(TRANSACTION_TOPIC).alias("topic"), F.col("key").cast("string").alias("key"), "value")
