"""Schemas of the landing rows and of the target tables.

Landing rows are decoded ledgers and transactions, one row each; opaque blobs ride along as text.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspring.functions.operations import ASSET, BODY, MUXED


@functools.cache
def table_schema(name: str) -> T.StructType:
    """Schema of a target table; Spark parses it, so a session must be there."""
    return T.StructType.fromDDL(TABLES[name])


CHANGE = "struct<change_type:string,entry_type:string,contract_type:string,contract_id:binary,key_type:string>"
EVENT = "struct<contract_id:binary,type:smallint,body_v:int,topics:array<struct<xdr:string,val:variant>>,data:struct<xdr:string,val:variant>>"
TOKEN_EVENT = f"struct<kind:string,`from`:string,`to`:string,amount:string,asset:{ASSET},contract_address:string,tx_hash:string,op_index:int,closed_at:timestamp,to_muxed_id:decimal(20,0)>"

LEDGERS_RAW = (
    "sequence bigint, hash string, ledger_close_time string, header struct<ledger_seq:bigint,previous_ledger_hash:binary,total_coins:bigint,"
    "fee_pool:bigint,base_fee:int,base_reserve:int,max_tx_set_size:int,ledger_version:int>, header_xdr string, "
    f"token_events array<{TOKEN_EVENT}>"
)
TRANSACTIONS_RAW = (
    f"ledger bigint, application_order int, status string, fee_bump boolean, created_at bigint, hash_payload binary, source {MUXED}, seq_num bigint,"
    "max_fee bigint, result struct<code:string,fee_charged:bigint>, memo struct<type:smallint,text:string,id:decimal(20,0),hash:binary>, "
    f"operations array<struct<type:smallint,type_name:string,source:{MUXED},body:{BODY}>>, "
    f"meta struct<v:int,tx_changes_after:array<{CHANGE}>,v3_events:array<{EVENT}>,operations:array<struct<changes:array<{CHANGE}>,events:array<{EVENT}>>>>, "
    "envelope_xdr string, result_xdr string, result_meta_xdr string"
)
INSTANCES = "contract_id string, executable_type string, wasm_hash binary"
CODES = "wasm_hash string, code binary, spec_xdr string, spec array<struct<kind:string,name:string,doc:string,inputs:array<struct<name:string,type:string>>,outputs:array<string>>>"
TOKEN_METADATA = "contract_id string, name string, symbol string, decimals int"

TABLES = {
    "ledgers": (
        "sequence bigint, hash string, prev_hash string, closed_at timestamp, total_coins bigint, fee_pool bigint, base_fee int, base_reserve int, max_tx_set_size int,"
        "protocol_version int, transaction_count int, operation_count int, successful_tx_count int, failed_tx_count int, header_xdr string"
    ),
    "transactions": (
        "hash string, ledger_sequence bigint, application_order int, account string, account_muxed string, account_muxed_id bigint, account_sequence bigint, fee_charged bigint,"
        "max_fee bigint, operation_count int, memo_type smallint, memo_text string, memo_hash string, time_bounds_min bigint, time_bounds_max bigint, status smallint,"
        "is_soroban boolean, soroban_resources string, envelope_xdr string, result_xdr string, result_meta_xdr string, fee_meta_xdr string, created_at timestamp"
    ),
    "operations": (
        "transaction_hash string, application_order int, type smallint, type_name string, source_account string, source_account_muxed string, source_muxed_id bigint,"
        "asset_code string, asset_issuer string, amount decimal(38,7), destination string, destination_muxed string, destination_muxed_id bigint, contract_id string, function_name string,"
        "details string, created_at timestamp"
    ),
    "token_events": (
        "event_type smallint, event_type_name string, from_address string, from_muxed string, to_address string, to_muxed string, to_muxed_id bigint, asset_type smallint,"
        "asset_code string, asset_issuer string, asset_contract_id string, amount decimal(38,0), transaction_hash string, ledger_sequence bigint, event_ordinal int,"
        "operation_index int, created_at timestamp"
    ),
    "contract_events": (
        "contract_id string, transaction_hash string, ledger_sequence bigint, event_ordinal int, type smallint, topic_1 string, topic_2 string, topic_3 string, topic_4 string,"
        "topics_xdr string, value_xdr string, topics_decoded string, value_decoded string, created_at timestamp"
    ),
    "contracts": (
        "contract_id string, contract_type smallint, wasm_hash string, is_token boolean, is_nft boolean, name string, symbol string, decimals int, spec_parsed string,"
        "creator_account string, created_ledger bigint, created_at timestamp, updated_at timestamp"
    ),
    "contract_code": "wasm_hash string, wasm_bytecode binary, wasm_size int, contract_spec string, spec_parsed string, contract_count bigint",
    "code_users": "wasm_hash string, contract_id string",
    "ingestion_state": "key string, value string, updated_at timestamp",
    "detected_contracts": "contract_id string, created_ledger bigint, created_at timestamp",
    "ingest_counters": "low bigint, high bigint, ledgers bigint, transactions bigint, operations bigint, token_events bigint, contract_events bigint, errors bigint, publish_errors bigint, request string, at timestamp",
    "quarantine": "source string, reason string, ledger bigint, row string",
    "ledger_presence": "bucket bigint, bits binary",
    "known_accounts": "address string, label string, category string, domain string, description string, tags array<string>, verified boolean, created_at timestamp, updated_at timestamp",
    "label_postings": "word string, address string",
    "label_words": "stem string, word string",
    "agg_balances": "asset_code string, asset_issuer string, holder string, balance decimal(38,0), upto bigint, mark boolean",
    "agg_supply": "asset_code string, asset_issuer string, supply decimal(38,0), upto bigint, mark boolean",
    "agg_transfer_candles": (
        "asset_code string, asset_issuer string, day date, open struct<at:timestamp,ledger:bigint,ordinal:int,amount:decimal(38,0)>, high decimal(38,0), low decimal(38,0),"
        "close struct<at:timestamp,ledger:bigint,ordinal:int,amount:decimal(38,0)>, n bigint, upto bigint, mark boolean"
    ),
    "agg_days": "day date, n bigint, fees bigint, n_fees bigint, n_soroban bigint, upto bigint, mark boolean",
    "agg_contract_events": "contract_id string, event_count bigint, upto bigint, mark boolean",
}

#: Keys of aggregates that are kept as partial rows, and how their columns merge.
STATE_KEYS = {
    "agg_balances": ["asset_code", "asset_issuer", "holder"],
    "agg_supply": ["asset_code", "asset_issuer"],
    "agg_transfer_candles": ["asset_code", "asset_issuer", "day"],
    "agg_days": ["day"],
    "agg_contract_events": ["contract_id"],
}
MERGES = {
    "agg_balances": {"balance": "sum"},
    "agg_supply": {"supply": "sum"},
    "agg_transfer_candles": {"open": "min", "high": "max", "low": "min", "close": "max", "n": "sum"},
    "agg_days": {"n": "sum", "fees": "sum", "n_fees": "sum", "n_soroban": "sum"},
    "agg_contract_events": {"event_count": "sum"},
}

#: Natural keys by which a replayed row is known, and the column and unit of the time partitions.
KEYS = {
    "ledgers": ["sequence", "closed_at"],
    "transactions": ["hash", "created_at"],
    "operations": ["transaction_hash", "application_order"],
    "token_events": ["ledger_sequence", "event_ordinal"],
    "contract_events": ["transaction_hash", "event_ordinal"],
}
#: Keys of tables that lie in hash buckets, each bucket a chunk, and their number.
BUCKETS = {"contracts": ("contract_id", 64), "contract_code": ("wasm_hash", 64), "code_users": ("wasm_hash", 64), "known_accounts": ("address", 64), "label_postings": ("word", 64), "label_words": ("stem", 64)}
BUCKET_KEYS = {"contracts": ["contract_id"], "contract_code": ["wasm_hash"], "code_users": ["wasm_hash", "contract_id"], "known_accounts": ["address"], "label_postings": ["word", "address"], "label_words": ["stem", "word"]}
CHUNKS = {"ledgers": ("closed_at", "month"), "transactions": ("created_at", "week"), "operations": ("created_at", "week"), "token_events": ("created_at", "week"), "contract_events": ("created_at", "week")}
SEGMENTS = {"ledgers": "closed_at", "transactions": "account", "operations": "type", "token_events": "event_type", "contract_events": "contract_id"}
#: Columns by which rows are looked up other than by segment and time; compacted files have a Bloom filter for each.
BLOOMS = {
    "ledgers": ["hash"],
    "transactions": ["hash", "account", "ledger_sequence"],
    "operations": ["transaction_hash", "source_account", "destination", "asset_code", "contract_id"],
    "token_events": ["transaction_hash", "from_address", "to_address", "asset_code", "ledger_sequence"],
    "contract_events": ["transaction_hash", "contract_id", "topic_1", "ledger_sequence"],
}


def folded_state(rows: DataFrame) -> DataFrame:
    """Of each key what readers of the state ask for: the last deletion, and since then the least, greatest and newest values."""
    key = Window.partitionBy("key")
    told = rows.withColumn("_gone", F.max(F.when(F.col("value").isNull(), F.col("updated_at"))).over(key))
    told = told.filter((F.col("value").isNull() & (F.col("updated_at") == F.col("_gone"))) | F.col("_gone").isNull() | (F.col("updated_at") > F.col("_gone")))
    number, live = F.col("value").try_cast("bigint"), Window.partitionBy("key", F.col("value").isNull())
    ends = (F.min(number).over(live) == number) | (F.max(number).over(live) == number) | (F.max("updated_at").over(live) == F.col("updated_at"))
    return told.withColumn("_keep", F.col("value").isNull() | F.coalesce(ends, F.lit(False))).filter("_keep").select(*rows.columns).distinct()


def folded_counters(rows: DataFrame) -> DataFrame:
    """One row for each day."""
    sums = [c for c in rows.columns if c not in ("low", "high", "request", "at")]
    days = rows.groupBy(F.to_date("at").alias("_day")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("at").alias("at"), *(F.sum(c).alias(c) for c in sums))
    return days.select(*(F.col(c) if c != "request" else F.lit(None).cast("string").alias(c) for c in rows.columns))


def folded_presence(rows: DataFrame) -> DataFrame:
    """One bitmap for each bucket."""
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


#: How compaction merges the rows of tables that only their sums or ends are read of.
FOLDS = {"ingestion_state": folded_state, "ingest_counters": folded_counters, "ledger_presence": folded_presence}
