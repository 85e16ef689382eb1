"""Bounded and keyed reads of landing tables, and landing rows from nested ledger documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ledgers of a partition folder of the data lake.
LEDGERS_PER_PARTITION = 64_000
PART = "part"
#: No ledger document exists under this sequence.
FIRST_LEDGER = 3


def ledger_range(landing: DataFrame, start: int, end: int, column: str = "sequence") -> DataFrame:
    """Rows from start to end, both included; pushed to the scan."""
    if end < start:
        raise ValueError(f"range ends at {end}, before its start {start}")
    return landing.filter(F.col(column).between(start, end))


def lake_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """The same of a lake partitioned by ``part`` = sequence / 64,000; partitions outside are pruned."""
    start = max(FIRST_LEDGER, start)
    found = ledger_range(spark.read.parquet(path), start, end)
    return found.filter(F.col("part").between(start // LEDGERS_PER_PARTITION, end // LEDGERS_PER_PARTITION))


def lake_partition(sequence: Column) -> Column:
    return F.floor(sequence / LEDGERS_PER_PARTITION).cast("bigint")


def land(rows: DataFrame, path: str, column: str) -> None:
    """Adds landing rows in the lake's layout, partitioned by ``part``."""
    rows.withColumn(PART, lake_partition(F.col(column))).write.mode("append").partitionBy(PART).parquet(path)


def raw(spark: SparkSession, path: str, schema: str, parts: list[int] | None = None) -> DataFrame:
    """Landing rows of all parts, or of those of a list; only their folders are listed. Parts that aren't there are left out."""
    reader = spark.read.schema(f"{schema}, {PART} bigint").option("basePath", path)
    if parts is None:
        return reader.parquet(path)
    there = set(parts_there(spark, path))
    found = [f"{path}/{PART}={p}" for p in sorted(set(parts) & there)]
    return reader.parquet(*found).filter(F.col(PART).isin(sorted(set(parts)))) if found else spark.createDataFrame([], f"{schema}, {PART} bigint")


def parts_there(spark: SparkSession, path: str) -> list[int]:
    """The parts that have a folder."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(there)] if fs.exists(there) else []
    return sorted(int(n.removeprefix(f"{PART}=")) for n in names if n.startswith(f"{PART}="))


def parts_from(path: str, least: int) -> str:
    """A path pattern for the parts from ``least`` on, so that a stream doesn't list the history before it."""
    digits = str(max(0, least))
    told = [digits]
    for k, d in enumerate(digits):
        if d < "9":
            told.append(f"{digits[:k]}[{int(d) + 1}-9]" + "[0-9]" * (len(digits) - k - 1))
    told.append("[1-9]" + "[0-9]" * len(digits) + "*")
    return f"{path}/{PART}={{{','.join(told)}}}"


def latest(landing: DataFrame, column: str = "sequence") -> DataFrame:
    return landing.agg(F.max(column).alias("latest"))


def lookup(snapshot: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of the snapshot with one of the keys; Spark broadcasts the keys if they are few."""
    return snapshot.join(keys.select(key).distinct(), key, "left_semi")


def cursor(state: DataFrame, key: str = "last_ingested_ledger") -> DataFrame:
    """One row with the greatest value of the key since it was last deleted; 0 if there is none."""
    mine = state.filter(F.col("key") == key)
    deleted = mine.filter("value IS NULL").agg(F.max("updated_at").alias("deleted"))
    since = mine.crossJoin(deleted).filter("deleted IS NULL OR updated_at > deleted")  # one row on the right
    return since.agg(F.coalesce(F.max(F.col("value").cast("bigint")), F.lit(0)).alias("last"))


def ledger_rows(documents: DataFrame) -> DataFrame:
    """Landing ledgers from documents (hash binary, close_time bigint, header, header_xdr, token_events, transactions)."""
    return documents.select(F.col("header.ledger_seq").alias("sequence"), F.lower(F.hex("hash")).alias("hash"), F.col("close_time").cast("string").alias("ledger_close_time"), "header", "header_xdr", "token_events")


def transaction_rows(documents: DataFrame) -> DataFrame:
    """Landing transactions from the documents' transactions, in order from 1."""
    each = documents.select(F.col("header.ledger_seq").alias("ledger"), F.col("close_time").alias("created_at"), F.posexplode("transactions").alias("pos", "tx"))
    fields = [f for f in documents.schema["transactions"].dataType.elementType.names if f != "successful"]
    status = F.when(F.col("tx.successful"), "SUCCESS").otherwise("FAILED")
    return each.select("ledger", (F.col("pos") + 1).alias("application_order"), status.alias("status"), "created_at", *(F.col(f"tx.{f}").alias(f) for f in fields))
