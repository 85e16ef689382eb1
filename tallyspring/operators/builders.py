"""Rows of the target tables from landing rows. Rows that can't be built go to quarantine; their batch goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspring.functions import scalars as S
from tallyspring.functions.addresses import split_addresses
from tallyspring.functions.operations import details, promoted
from tallyspring.operators import trees
from tallyspring.schemas import table_schema


def typed(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in its types; those that the rows lack are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table_schema(table).fields))


Hold = Callable[[DataFrame], DataFrame]


def as_is(df: DataFrame) -> DataFrame:
    return df


def split(df: DataFrame, reason: Column, hold: Hold = as_is) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their reason). ``hold`` may persist what both are read from."""
    told = hold(df.withColumn("reason", reason))
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null")


def rollup(ledgers: DataFrame, transactions: DataFrame, *, ledger_key: str, tx_key: str, success: Column, n_operations: Column | None = None, usable: Column | None = None) -> DataFrame:
    """Ledgers with the counts of their transactions; zeros for ledgers without any, and no row for other transactions.

    All transactions count, successful or else failed (a null status is a failure); operations count only where
    ``usable`` holds. Transactions are aggregated before the join.
    """
    good = F.coalesce(success, F.lit(False))
    operations = F.lit(0) if n_operations is None else F.when(F.lit(True) if usable is None else usable, n_operations).otherwise(0)
    counts = transactions.groupBy(F.col(tx_key).alias("_ledger")).agg(
        F.count("*").alias("transaction_count"), F.count_if(good).alias("successful_tx_count"), F.count_if(~good).alias("failed_tx_count"), F.sum(operations).alias("operation_count")
    )
    names = ("transaction_count", "successful_tx_count", "failed_tx_count", "operation_count")
    joined = ledgers.join(counts, ledgers[ledger_key] == counts["_ledger"], "left")
    return joined.select(*(ledgers[c] for c in ledgers.columns), *(F.coalesce(counts[n], F.lit(0)).cast("bigint").alias(n) for n in names))


def ledger_table(ledgers_raw: DataFrame, transactions_raw: DataFrame, parsed: Column | None = None, hold: Hold = as_is) -> tuple[DataFrame, DataFrame]:
    """Ledgers with their roll-up; a ledger without a readable close time goes to quarantine."""
    rolled = rollup(ledgers_raw, transactions_raw, ledger_key="sequence", tx_key="ledger", success=F.col("status") == "SUCCESS", n_operations=F.coalesce(F.size("operations"), F.lit(0)), usable=transaction_problem().isNull() if parsed is None else parsed)
    named = rolled.select(
        "sequence", "hash", S.hex_text(F.col("header.previous_ledger_hash")).alias("prev_hash"), S.parse_time(F.col("ledger_close_time")).alias("closed_at"), "header.total_coins", "header.fee_pool",
        "header.base_fee", "header.base_reserve", "header.max_tx_set_size", F.col("header.ledger_version").alias("protocol_version"), "transaction_count", "operation_count", "successful_tx_count", "failed_tx_count", "header_xdr",
    )
    good, bad = split(named, F.when(F.col("closed_at").isNull(), "close time"), hold)
    return typed(good, "ledgers"), bad


def transaction_problem() -> Column:
    """Why a landing transaction can't be built; null if it can."""
    return F.when(F.col("hash_payload").isNull(), "envelope").when(F.col("result").isNull(), "result").when(F.col("source.base").isNull(), "source").when(S.epoch_time(F.col("created_at")).isNull(), "created_at")


def transaction_table(transactions_raw: DataFrame, domain: Column) -> tuple[DataFrame, DataFrame]:
    good, bad = split(transactions_raw, transaction_problem())
    memo = F.col("memo")
    rows = good.select(
        S.transaction_digest(domain, F.col("hash_payload")).alias("hash"), F.col("ledger").alias("ledger_sequence"), "application_order", F.col("source.base").alias("account"), F.col("source.muxed").alias("account_muxed"),
        S.wrapped_long(F.col("source.muxed_id")).alias("account_muxed_id"), F.col("seq_num").alias("account_sequence"), "result.fee_charged", "max_fee", F.coalesce(F.size("operations"), F.lit(0)).alias("operation_count"),
        memo["type"].alias("memo_type"), S.memo_text(memo["type"], memo["text"], memo["id"]).alias("memo_text"), S.memo_hash(memo["type"], memo["hash"]).alias("memo_hash"), S.status_flag(F.col("result.code")).alias("status"),
        has_contract_operation(F.col("operations")).alias("is_soroban"), "envelope_xdr", "result_xdr", "result_meta_xdr", S.epoch_time(F.col("created_at")).alias("created_at"),
    )
    return typed(rows, "transactions"), bad


def has_contract_operation(operations: Column) -> Column:
    return F.coalesce(F.exists(operations, lambda o: S.type_name(o["type_name"], o["type"]).isin(*S.CONTRACT_OPERATIONS)), F.lit(False))


def operation_table(transactions_raw: DataFrame, domain: Column, hold: Hold = as_is) -> tuple[DataFrame, DataFrame]:
    """One row per operation, in order from 1; those with a claim predicate that can't be shown at any depth go to quarantine."""
    good = transactions_raw.filter(transaction_problem().isNull())
    each = good.select(S.transaction_digest(domain, F.col("hash_payload")).alias("transaction_hash"), F.col("ledger").alias("ledger_sequence"), S.epoch_time(F.col("created_at")).alias("created_at"), F.posexplode("operations").alias("pos", "o"))
    each = each.withColumn("type_name", S.type_name(F.col("o.type_name"), F.col("o.type")))
    name, body = F.col("type_name"), F.col("o.body")
    predicates = F.when(name == "create_claimable_balance", F.transform(body["claimants"], lambda c: S.predicate(c["predicate"])))
    each = trees.complete(each.withColumn("predicates", predicates), F.transform(body["claimants"], lambda c: c["predicate"]), "predicates", trees.PREDICATES)
    each, bad = split(each, F.when(F.exists("predicates", lambda p: p.isNull()), "predicate"), hold)
    rows = each.select(
        "transaction_hash", (F.col("pos") + 1).alias("application_order"), "o.type", "type_name", F.col("o.source.base").alias("source_account"), F.col("o.source.muxed").alias("source_account_muxed"),
        S.wrapped_long(F.col("o.source.muxed_id")).alias("source_muxed_id"), *(c.alias(n) for n, c in promoted(name, body).items()), details(name, body, F.col("predicates")).alias("details"), "created_at",
    )
    return typed(rows, "operations"), bad.drop("predicates")


def contract_event_table(transactions_raw: DataFrame, domain: Column, hold: Hold = as_is) -> tuple[DataFrame, DataFrame]:
    """Events with a contract and a version-0 body, in order inside their transaction.

    Events with a topic or a value that is there but can't be shown at any depth go to quarantine.
    """
    good = transactions_raw.filter(transaction_problem().isNull())
    events = S.versioned_events(F.col("meta.v"), F.col("meta.v3_events"), F.col("meta.operations"))
    each = good.select(S.transaction_digest(domain, F.col("hash_payload")).alias("transaction_hash"), F.col("ledger").alias("ledger_sequence"), S.epoch_time(F.col("created_at")).alias("created_at"), F.posexplode(events).alias("event_ordinal", "e"))
    each = each.filter(F.col("e.contract_id").isNotNull() & (F.col("e.body_v") == 0))
    # the topics and then the value, as one list; null topics give null texts
    values = F.concat(F.coalesce(F.transform("e.topics", lambda t: t["val"]), F.array().cast("array<variant>")), F.array("e.data.val"))
    each = trees.complete(each.withColumn("texts", F.transform(values, lambda v: S.display(v))), values, "texts", trees.VALUES)
    each = each.withColumn("shown", F.when(F.col("e.topics").isNotNull(), F.slice("texts", 1, F.size("texts") - 1))).withColumn("shown_value", F.element_at("texts", -1))
    hidden = F.exists(F.zip_with("e.topics", "shown", lambda t, text: t["val"].isNotNull() & text.isNull()), lambda x: x)
    each, bad = split(each, F.when(hidden, "topics").when(F.col("e.data.val").isNotNull() & F.col("shown_value").isNull(), "value"), hold)
    rows = each.select(
        S.hex_text(F.col("e.contract_id")).alias("contract_id"), "transaction_hash", "ledger_sequence", "event_ordinal", "e.type", *(S.topic(F.col("shown"), i).alias(f"topic_{i + 1}") for i in range(4)),
        F.to_json(F.transform("e.topics", lambda t: t["xdr"])).alias("topics_xdr"), F.col("e.data.xdr").alias("value_xdr"), F.to_json("shown").alias("topics_decoded"), S.json_string(F.col("shown_value")).alias("value_decoded"), "created_at",
    )
    return typed(rows, "contract_events"), bad.drop("texts", "shown", "shown_value")


#: Widths of token-event fields in bytes, and the reason told for a wider one.
WIDTHS = {"event_type_name": 16, "from_address": 56, "to_address": 56, "from_muxed": 69, "to_muxed": 69, "asset_code": 12, "asset_issuer": 56, "asset_contract_id": 56}


def first_violation(widths: dict[str, int]) -> Column:
    """Name of the first field that is too wide; null if none is."""
    return F.coalesce(*(F.when(F.octet_length(F.col(name)) > most, name) for name, most in widths.items()))


def is_balance(address: Column) -> Column:
    """Claimable balances stand in transfers as addresses that start with B; false for a null."""
    return F.coalesce(address.startswith("B"), F.lit(False))


def token_event_table(ledgers_raw: DataFrame, hold: Hold = as_is) -> tuple[DataFrame, DataFrame]:
    """Token events by ledger and ordinal. Transfers of claimable balances are dropped; rows that are too wide, or without
    a known kind, an amount or a time, go to quarantine."""
    each = ledgers_raw.select(F.col("sequence").alias("ledger_sequence"), F.posexplode("token_events").alias("event_ordinal", "e"))
    each = each.filter(~is_balance(F.col("e.from")) & ~is_balance(F.col("e.to")))
    each = each.select("ledger_sequence", "event_ordinal", *(f"e.{c}" for c in ("kind", "from", "to", "amount", "asset", "contract_address", "tx_hash", "op_index", "closed_at")), F.col("e.to_muxed_id").alias("given_id"))
    each = split_addresses(split_addresses(each, "from", hold), "to", hold)
    a = F.col("asset")
    rows = each.select(
        F.element_at(F.create_map(*(F.lit(x) for pair in S.EVENT_CODES.items() for x in pair)), F.col("kind")).cast("smallint").alias("event_type"), F.col("kind").alias("event_type_name"), F.coalesce("from_base", "from").alias("from_address"), "from_muxed",
        F.coalesce("to_base", "to").alias("to_address"), "to_muxed", F.coalesce("to_muxed_id", S.wrapped_long(F.col("given_id"))).alias("to_muxed_id"), S.asset_class(a["kind"]).alias("asset_type"), F.when(a["kind"] == "issued", S.trimmed_code(a["code"])).alias("asset_code"),
        S.asset_issuer(a["kind"], a["issuer"]).alias("asset_issuer"), S.null_if_empty(F.col("contract_address")).alias("asset_contract_id"), F.col("amount").alias("amount_text"), F.col("amount").try_cast("decimal(38,0)").alias("amount"),
        F.col("tx_hash").alias("transaction_hash"), "ledger_sequence", "event_ordinal", F.col("op_index").alias("operation_index"), F.col("closed_at").alias("created_at"),
    )
    reason = F.coalesce(F.when(F.col("event_type").isNull(), "event_type_name"), first_violation(WIDTHS), F.when(F.col("amount").isNull(), "amount"), F.when(F.col("created_at").isNull(), "created_at"))
    good, bad = split(rows, reason, hold)
    return typed(good, "token_events"), bad


def explode_ordinals(df: DataFrame, array_col: str, *, order_col: str = "application_order", item_col: str = "item") -> DataFrame:
    """One row per item of an array, numbered from 1."""
    keep = [c for c in df.columns if c != array_col]
    return df.select(*keep, F.posexplode(array_col).alias(order_col, item_col)).withColumn(order_col, F.col(order_col) + 1)
