"""Contracts: detection in change lists, and classification by their functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspring.functions import scalars as S

# Functions that a contract must have to be a token or a collection.
TOKEN_FUNCTIONS = ("transfer", "balance", "decimals", "name", "symbol")
NFT_FUNCTIONS = ("owner_of", "token_uri", "transfer")
#: Executable of contracts that have code of their own.
WASM = "wasm"


def has_all(names: Column, required: tuple[str, ...]) -> Column:
    """Whether an array of names has all required ones, in any case; false for an empty or missing array."""
    lowered = F.transform(names, F.lower)
    missing = F.array_except(F.array(*map(F.lit, required)), lowered)
    return F.coalesce((F.size(names) > 0) & (F.size(missing) == 0), F.lit(False))


def all_changes(meta: Column) -> Column:
    """Changes after the transaction, then those of its operations, in a row."""
    return F.concat(F.coalesce(meta["tx_changes_after"], F.filter(F.flatten(F.transform(meta["operations"], lambda o: o["changes"])), lambda x: F.lit(False))), F.coalesce(F.flatten(F.transform(meta["operations"], lambda o: o["changes"])), F.filter(meta["tx_changes_after"], lambda x: F.lit(False))))


def is_new_contract(c: Column) -> Column:
    return (c["change_type"] == "created") & (c["entry_type"] == "contract_data") & (c["key_type"] == "instance") & (c["contract_type"] == "contract") & c["contract_id"].isNotNull()


def detect(transactions_raw: DataFrame) -> DataFrame:
    """New contracts: contract_id, created_ledger, created_at."""
    changes = transactions_raw.select(F.col("ledger").alias("created_ledger"), S.epoch_time(F.col("created_at")).alias("created_at"), F.explode(all_changes(F.col("meta"))).alias("c"))
    return changes.filter(F.coalesce(is_new_contract(F.col("c")), F.lit(False))).select(S.hex_text(F.col("c.contract_id")).alias("contract_id"), "created_ledger", "created_at")


def spec_json(spec: Column) -> Column:
    """Spec entries as a JSON array: functions with doc, inputs and outputs, other kinds with their name."""
    is_function = lambda e: e["kind"] == "function_v0"
    return F.to_json(F.transform(spec, lambda e: F.struct(e["kind"].alias("kind"), e["name"].alias("name"), F.when(is_function(e), e["doc"]).alias("doc"), F.when(is_function(e), e["inputs"]).alias("inputs"), F.when(is_function(e), e["outputs"]).alias("outputs"))))


def function_names(spec: Column) -> Column:
    return F.transform(F.filter(spec, lambda e: e["kind"] == "function_v0"), lambda e: e["name"])


def contract_rows(detected: DataFrame, instances: DataFrame, codes: DataFrame, metadata: DataFrame) -> DataFrame:
    """Contracts with their class, out of keyed snapshots.

    A contract without an instance is dropped, as is one with code whose code is missing; contracts of an asset have
    no code and are tokens. Code without a spec gives a contract that is neither. Metadata may be missing.
    """
    with_instance = detected.join(instances, "contract_id")
    code = codes.select(F.col("wasm_hash").alias("hash"), "spec")
    joined = with_instance.withColumn("hash", S.hex_text(F.col("wasm_hash"))).drop("wasm_hash").join(code, "hash", "left")
    own_code = F.col("executable_type") == WASM
    found = codes.select(F.col("wasm_hash").alias("known"))
    joined = joined.join(found, joined["hash"] == found["known"], "left").filter(~own_code | F.col("known").isNotNull()).join(metadata, "contract_id", "left")
    names = function_names(F.col("spec"))
    return joined.select(
        "contract_id", F.when(own_code, 0).otherwise(1).cast("smallint").alias("contract_type"), F.when(own_code, F.col("hash")).alias("wasm_hash"),
        F.when(own_code, has_all(names, TOKEN_FUNCTIONS)).otherwise(True).alias("is_token"), F.when(own_code, has_all(names, NFT_FUNCTIONS)).otherwise(False).alias("is_nft"), "name", "symbol", "decimals",
        F.when(own_code, spec_json(F.col("spec"))).alias("spec_parsed"), F.lit(None).cast("string").alias("creator_account"), "created_ledger", "created_at", F.current_timestamp().alias("updated_at"),
    )


def code_rows(contracts: DataFrame, codes: DataFrame) -> DataFrame:
    """Code rows of the contracts' hashes. ``spec_xdr`` is text in the landing rows, like their other blobs."""
    used = codes.join(contracts.filter("wasm_hash IS NOT NULL").select("wasm_hash").distinct(), "wasm_hash", "left_semi")
    return used.select("wasm_hash", F.col("code").alias("wasm_bytecode"), F.length("code").alias("wasm_size"), F.col("spec_xdr").alias("contract_spec"), spec_json(F.col("spec")).alias("spec_parsed"))
