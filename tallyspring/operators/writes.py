"""Write policies of the target tables, as DataFrames of new rows or of whole tables.

An append is an anti join and a merge is a full join, as plain Parquet has no row-level writes. Anti joins look only
into the time partitions that the batch touches. How tables lie in files is told in ``deltas``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspring.operators import deltas
from tallyspring.schemas import KEYS

def insert_if_absent(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's rows with keys that the target lacks, one for each key."""
    return batch.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def append(batch: DataFrame, folder: str, table: str) -> int:
    """Adds the rows that the table lacks, and returns how many the batch has. A replayed batch adds none.

    The target is read only in the batch's chunks: a batch spans few, and their counts are what comes to the driver.
    One writer at a time: what another one adds between the read and the commit isn't seen.
    """
    return upsert(batch, folder, table, [])


def upsert(batch: DataFrame, folder: str, table: str, compare: list[str]) -> int:
    """``append``, and where a row with the key is there whose columns of ``compare`` differ, the batch's row in its place."""
    spark, keys = batch.sparkSession, KEYS[table]
    rows = deltas.placed(batch, table).dropDuplicates(keys).persist()
    try:
        chunks = dict(rows.groupBy(deltas.CHUNK).count().collect())
        if not chunks:
            return 0
        target = deltas.read(spark, folder, table).filter(F.col(deltas.CHUNK).isin(list(chunks)))
        if not compare:
            deltas.commit(rows.join(target.select(*keys), keys, "left_anti"), folder, table)
            return sum(chunks.values())
        there = target.select(*(F.col(k).alias(f"there_{k}") for k in keys), F.struct(*compare).alias("there"))
        joined = rows.join(there, [F.col(k) == F.col(f"there_{k}") for k in keys], "left").filter(~F.struct(*compare).eqNullSafe(F.col("there")))
        deltas.commit(joined, folder, table, deletes=joined.filter(F.col("there").isNotNull()).select(*keys))
        return sum(chunks.values())
    finally:
        rows.unpersist()


def fold(arrivals: DataFrame, key: str, order: str, *, overwrite: list[str], keep: list[str], first: list[str]) -> DataFrame:
    """One row for each key out of its arrivals in order: the last value, the last that isn't null, the first."""
    whole = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = {c: F.last(c).over(whole) for c in overwrite} | {c: F.last(c, ignorenulls=True).over(whole) for c in keep} | {c: F.first(c).over(whole) for c in first}
    ranked = arrivals.select(key, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("_n"), *(v.alias(c) for c, v in columns.items()))
    return ranked.filter("_n = 1").drop("_n")


def merge(old: DataFrame, new: DataFrame, key: str, *, overwrite: list[str], keep: list[str], first: list[str]) -> DataFrame:
    """Upsert with a policy for each column: overwrite (null too), keep the old where the new is null, or first writer wins."""
    o, n = old.alias("o"), new.alias("n")
    came = F.col(f"n.{key}").isNotNull()
    had = F.col(f"o.{key}").isNotNull()
    columns = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    columns += [F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in overwrite]
    columns += [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in keep]
    columns += [F.when(had, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in first]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


#: Policy of the contracts table.
CONTRACT_POLICY = {
    "overwrite": ["contract_type", "wasm_hash", "is_token", "is_nft", "updated_at"],
    "keep": ["name", "symbol", "decimals", "spec_parsed"],
    "first": ["creator_account", "created_ledger", "created_at"],
}

#: Policy of the code table.
CODE_POLICY = {"overwrite": [], "keep": ["contract_spec", "spec_parsed"], "first": ["wasm_bytecode", "wasm_size"]}


def upsert_contracts(old: DataFrame, arrivals: DataFrame, order: str = "created_ledger") -> DataFrame:
    return merge(old, fold(arrivals, "contract_id", order, **CONTRACT_POLICY), "contract_id", **CONTRACT_POLICY)


def upsert_codes(old: DataFrame, new: DataFrame, contracts: DataFrame) -> DataFrame:
    """Codes merged by hash; ``contract_count`` is the number of contracts with the hash, so a replay doesn't raise it."""
    merged = merge(old.drop("contract_count"), new.dropDuplicates(["wasm_hash"]), "wasm_hash", **CODE_POLICY)
    counts = contracts.filter("wasm_hash is not null").groupBy("wasm_hash").agg(F.count_distinct("contract_id").alias("contract_count"))
    return merged.join(counts, "wasm_hash", "left").withColumn("contract_count", F.coalesce("contract_count", F.lit(0)))


def write_contracts(arrivals: DataFrame, codes_of: Callable[[DataFrame], DataFrame], folder: str, order: str = "created_ledger") -> None:
    """Merges contracts and their code into tables that lie in hash buckets; only buckets of the arrivals' keys are read,
    and only their rows written.

    How many contracts have a code is counted from the pairs in ``code_users``, for the codes that the arrivals change.
    Contracts are written last: a crash before leaves the old ones, and a replay works the same out again.
    """
    spark = arrivals.sparkSession
    new = fold(arrivals, "contract_id", order, **CONTRACT_POLICY)
    old = deltas.touched(spark, folder, "contracts", new).drop(deltas.CHUNK).persist()
    merged = merge(old, new, "contract_id", **CONTRACT_POLICY).persist()
    try:
        pairs = lambda df: df.filter("wasm_hash IS NOT NULL").select("wasm_hash", "contract_id")
        now, was = pairs(merged), pairs(old)
        deltas.commit(now, folder, "code_users", deletes=was.union(now))
        hashes = now.union(was).select("wasm_hash").distinct().persist()
        counts = deltas.touched(spark, folder, "code_users", hashes).groupBy("wasm_hash").agg(F.count("*").alias("contract_count"))
        before = deltas.touched(spark, folder, "contract_code", hashes).drop(deltas.CHUNK, "contract_count")
        code = merge(before, codes_of(now).dropDuplicates(["wasm_hash"]), "wasm_hash", **CODE_POLICY)
        code = code.join(counts, "wasm_hash", "left").withColumn("contract_count", F.coalesce("contract_count", F.lit(0)))
        deltas.put(code.persist(), folder, "contract_code")
        deltas.put(merged, folder, "contracts")
        code.unpersist(), hashes.unpersist()
    finally:
        merged.unpersist(), old.unpersist()


def advance_cursor(state: DataFrame, seen: DataFrame, column: str = "sequence", key: str = "last_ingested_ledger") -> DataFrame:
    """The state with its cursor at the greatest sequence seen so far; it never moves back."""
    top = seen.agg(F.max(F.col(column).cast("bigint")).alias("top"))
    mine = state.filter(F.col("key") == key).agg(F.max(F.col("value").cast("bigint")).alias("old"))
    row = mine.crossJoin(top).select(F.lit(key).alias("key"), F.greatest("old", "top").cast("string").alias("value"), F.current_timestamp().alias("updated_at")).filter("value is not null")  # one row each
    return state.filter(F.col("key") != key).unionByName(row)


def delete_ledger(sequence: int, ledgers: DataFrame, transactions: DataFrame, operations: DataFrame, *, hash_col: str = "hash") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a ledger, its transactions and their operations."""
    gone = transactions.filter(F.col("ledger_sequence") == sequence).select(F.col(hash_col).alias("transaction_hash")).distinct()
    return ledgers.filter(F.col("sequence") != sequence), transactions.filter(F.col("ledger_sequence") != sequence), operations.join(gone, "transaction_hash", "left_anti")


def reset_cursor(spark: SparkSession, folder: str, key: str = "last_ingested_ledger") -> None:
    """Deletes one key of the ingestion state, by a row that takes back the ones before it; tables stay as they are."""
    gone = spark.range(1, numPartitions=1).select(F.lit(key).alias("key"), F.lit(None).cast("string").alias("value"), F.current_timestamp().alias("updated_at"))
    deltas.commit(gone, folder, "ingestion_state")


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two versions of a table; columns that one lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)
