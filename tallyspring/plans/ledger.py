"""Each ledger operator applied to the driver's tables, with the same result in SQL."""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspring.functions import scalars as S
from tallyspring.functions.addresses import ACCOUNT_VERSION, MUXED_VERSION, checksum, split_addresses
from tallyspring.functions.operations import BODY, details, promoted
from tallyspring.operators import builders, contracts, gaps, label_index, rollups, trees, writes
from tallyspring.sources import landing
from tallyspring.streaming.publish import json_arrays

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        ORACLES[query.__name__] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


@registered("""
SELECT o_orderkey, count(l_orderkey) AS transaction_count, count(*) FILTER (l_returnflag = 'N') AS successful_tx_count,
       count(l_orderkey) FILTER (l_returnflag IS DISTINCT FROM 'N') AS failed_tx_count,
       coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE 0 END) FILTER (l_orderkey IS NOT NULL), 0)::BIGINT AS operation_count
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")
def ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")
    return builders.rollup(orders, lines, ledger_key="o_orderkey", tx_key="l_orderkey", success=F.col("l_returnflag") == "N", n_operations=F.col("l_linenumber"), usable=F.col("l_linestatus") == "O")


@registered(f"""
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL})::INTEGER AS application_order, l_partkey, l_quantity FROM lineitem
""")
def explode_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER))).alias("lines"))
    return builders.explode_ordinals(lines, "lines", item_col="l").select("l_orderkey", "application_order", "l.l_partkey", "l.l_quantity")


#: Tags that stand for the five event types.
TAGS = {"click": "payment", "error": "manage_sell_offer", "purchase": "create_account", "signup": "liquidity_pool_deposit", "view": "claim_claimable_balance"}
TAG_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAGS.items()) + " END"


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    issued = F.struct(F.lit("issued").alias("kind"), F.col("event_type").alias("code"), F.col("user_id").cast("string").alias("issuer"))
    native = F.struct(F.lit("native").alias("kind"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("issuer"))
    account = F.struct(F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("base"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("M"), F.col("user_id").cast("string"))).alias("muxed"), F.col("event_id").cast("decimal(20,0)").alias("muxed_id"))
    price = F.struct(F.col("event_id").alias("n"), F.col("user_id").alias("d"))
    filled = {
        "destination": account, "amount": cents, "asset": F.when(F.col("event_id") % 3 == 0, native).otherwise(issued), "starting_balance": cents + 1, "selling": issued, "buying": native, "price": price, "offer_id": F.col("event_id"),
        "pool_id": F.col("event_type").cast("binary"), "max_amount_a": cents, "max_amount_b": cents + 2, "min_price": price, "max_price": price, "balance_type": F.lit(0), "balance_hash": F.col("event_type").cast("binary"),
        "contract_id": F.col("event_type").cast("binary"), "function_type": F.col("user_id").cast("string"),
    }
    fields = T.StructType.fromDDL(f"body {BODY}")["body"].dataType.fields
    body = F.struct(*(filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    tag = F.element_at(F.create_map(*(F.lit(x) for pair in TAGS.items() for x in pair)), F.col("event_type"))
    return events.select("event_id", tag.alias("tag"), body.alias("body"))


ASSET_SQL = "CASE WHEN event_id % 3 = 0 THEN 'native' ELSE event_type || ':' || user_id END"
CENTS_SQL = "round(value * 100)::BIGINT"


@registered(f"""
SELECT event_id, {TAG_SQL} AS tag,
  CASE WHEN event_type IN ('click', 'purchase') THEN CASE WHEN event_id % 2 = 0 THEN 'M' ELSE 'G' END || user_id END AS destination,
  CASE WHEN event_type IN ('click', 'error') THEN {CENTS_SQL}::VARCHAR END AS amount,
  CASE WHEN event_type = 'click' THEN {ASSET_SQL} END AS asset,
  CASE WHEN event_type = 'purchase' THEN ({CENTS_SQL} + 1)::VARCHAR END AS starting_balance,
  CASE WHEN event_type = 'error' THEN event_type || ':' || user_id END AS selling,
  CASE WHEN event_type = 'error' THEN event_id || '/' || user_id END AS price,
  CASE WHEN event_type = 'signup' THEN lower(hex(event_type::BLOB)) END AS liquidity_pool_id,
  CASE WHEN event_type = 'view' THEN '00000000' || lower(hex(event_type::BLOB)) END AS balance_id,
  CASE event_type WHEN 'click' THEN 4 WHEN 'error' THEN 6 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 6 ELSE 2 END AS n_keys
FROM events
""")
def details_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = bodies(spark, sf_dir).select("event_id", details(F.col("tag"), F.col("body")).alias("d"))
    keys = ["destination", "amount", "asset", "starting_balance", "selling", "price", "liquidity_pool_id", "balance_id"]
    return told.select("event_id", F.get_json_object("d", "$.type").alias("tag"), *(F.get_json_object("d", f"$.{k}").alias(k) for k in keys), F.size(F.json_object_keys("d")).alias("n_keys"))


@registered(f"""
SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'G' || user_id END AS destination,
  CASE WHEN event_type IN ('click', 'purchase') AND event_id % 2 = 0 THEN 'M' || user_id END AS destination_muxed,
  CASE WHEN event_type IN ('click', 'purchase') THEN event_id END AS destination_muxed_id,
  CASE WHEN event_type IN ('click', 'error') THEN {CENTS_SQL} WHEN event_type = 'purchase' THEN {CENTS_SQL} + 1 END AS amount,
  CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'XLM' WHEN event_type IN ('click', 'error') THEN event_type END AS asset_code,
  CASE WHEN event_type = 'error' OR event_type = 'click' AND event_id % 3 <> 0 THEN user_id::VARCHAR END AS asset_issuer,
  CASE WHEN event_type = 'view' THEN lower(hex(event_type::BLOB)) END AS contract_id, CASE WHEN event_type = 'view' THEN user_id::VARCHAR END AS function_name
FROM events
""")
def promoted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bodies(spark, sf_dir).withColumn("tag", F.when(F.col("tag") == TAGS["view"], "invoke_host_function").otherwise(F.col("tag")))
    columns = promoted(F.col("tag"), F.col("body"))
    return rows.select("event_id", *(c.alias(n) for n, c in columns.items())).withColumn("amount", F.col("amount").cast("bigint"))


@registered("""
SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS code,
  CASE WHEN octet_length(props::BLOB) > 8 THEN 'props' WHEN octet_length(event_type::BLOB) > 6 THEN 'event_type' END AS violation,
  CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS asset_type
FROM events WHERE NOT starts_with(props, 'B') AND NOT coalesce(starts_with(CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN 'B' || user_id ELSE 'G' || user_id END, 'B'), false)
""")
def event_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = dict(zip(("click", "error", "purchase", "signup", "view"), S.EVENT_CODES.values(), strict=True))
    code = F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), F.col("event_type"))
    sender = F.when(F.col("user_id") % 5 == 0, F.lit(None)).when(F.col("user_id") % 5 == 1, F.concat(F.lit("B"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("G"), F.col("user_id").cast("string")))
    kind = F.when(F.col("event_id") % 3 == 1, "issued").when(F.col("event_id") % 3 == 2, "native")
    kept = table(spark, sf_dir, "events").filter(~builders.is_balance(F.col("props")) & ~builders.is_balance(sender))
    return kept.select("event_id", code.alias("code"), builders.first_violation({"props": 8, "event_type": 6}).alias("violation"), S.asset_class(kind).cast("int").alias("asset_type"))


@registered("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN o_custkey::VARCHAR END AS memo_text,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN lower(hex(o_orderpriority::BLOB)) END AS memo_hash,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS status, coalesce(any_r, false) AS is_soroban
FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_r FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
""")
def memo_status_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_returnflag") == "R", "OperationTypeRestoreFootprint").otherwise("OperationTypePayment")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(name.alias("type_name"), F.col("l_linenumber").alias("type"))).alias("operations"))
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    kind = F.when(F.col("o_orderstatus") == "F", S.MEMO_TEXT).when(F.col("o_orderstatus") == "O", S.MEMO_ID).otherwise(S.MEMO_HASH)
    return joined.select(
        "o_orderkey", S.memo_text(kind, F.col("o_orderpriority"), F.col("o_custkey")).alias("memo_text"), S.memo_hash(kind, F.col("o_orderpriority").cast("binary")).alias("memo_hash"),
        S.status_flag(F.when(F.col("o_orderpriority") == "1-URGENT", S.SUCCESS_CODES[0])).cast("int").alias("status"), builders.has_contract_operation(F.col("operations")).alias("is_soroban"),
    )


@registered("""
SELECT event_id, CASE WHEN event_id % 9 IN (0, 1) THEN epoch(date_trunc('second', ts))::BIGINT WHEN event_id % 9 = 2 THEN epoch(date_trunc('second', ts))::BIGINT - 19800 END AS seconds FROM events
""")
def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds, RFC 3339 in two zones, and texts that are no time: a year with words, a number past the range of
    time, one past 64 bits, a month, a day, a time of day."""
    iso, rest = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("event_id") % 9
    forms = [
        F.unix_seconds(F.to_timestamp(iso)).cast("string"), iso, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".5+05:30")), F.concat(F.date_format("ts", "yyyy"), F.lit(" or so")), F.lit(str(2**63 - 1)),
        F.concat(F.lit("1"), F.lpad(F.col("event_id").cast("string"), 20, "0")), F.date_format("ts", "yyyy-MM"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"),
    ]
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(rest == i, form).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(S.parse_time(text)).alias("seconds"))


@registered("""
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '') AS camel, replace(p_name, ' ', '_') AS snake,
  CASE WHEN p_size % 4 = 0 THEN 'unknown_' || p_size ELSE replace(p_name, ' ', '_') END AS type_name
FROM part
""")
def name_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    name = F.when(F.col("p_size") % 4 == 0, F.lit("OperationType")).otherwise(F.concat(F.lit("OperationType"), camel))
    return table(spark, sf_dir, "part").select("p_partkey", camel.alias("camel"), S.snake_case(camel).alias("snake"), S.type_name(name, F.col("p_size")).alias("type_name"))


@registered("""
SELECT c_custkey, lower(hex(c_name::BLOB)) AS hex, to_base64(c_name::BLOB) AS base64, sha256(unhex(sha256('network')) || c_name::BLOB) AS digest,
  lpad(lower(to_hex(c_nationkey)), 8, '0') || lower(hex(c_mktsegment::BLOB)) AS balance_id, '0x' || lower(hex(c_mktsegment::BLOB)) AS prefixed
FROM customer
""")
def hex_base64_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, segment = F.col("c_name").cast("binary"), F.col("c_mktsegment").cast("binary")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.hex_text(raw).alias("hex"), S.base64_text(raw).alias("base64"), S.transaction_digest(F.lit("network").cast("binary"), raw).alias("digest"), S.balance_id(F.col("c_nationkey"), segment).alias("balance_id"), S.prefixed_hex(segment).alias("prefixed")
    )


@registered("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'native' WHEN 1 THEN p_brand || ':' || p_type ELSE 'unknown' END AS asset, CASE p_size % 3 WHEN 0 THEN 'XLM' WHEN 1 THEN p_brand END AS code,
  CASE p_size % 3 WHEN 1 THEN p_type END AS issuer, CASE WHEN p_size % 3 = 2 THEN 'liquidity_pool:' || lower(hex(p_brand::BLOB)) WHEN p_size % 3 = 0 THEN 'native' ELSE p_brand || ':' || p_type END AS trust_line,
  CASE WHEN p_size % 3 <> 0 THEN p_name END AS not_empty, p_size || '/' || p_partkey AS price
FROM part
""")
def asset_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.col("p_size") % 3
    kind = F.when(rest == 0, "native").when(rest == 1, "issued").otherwise("pool_share")
    code, issuer = F.concat("p_brand", F.lit("\0\0")), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.asset_text(kind, code, issuer).alias("asset"), S.asset_code(kind, code).alias("code"), S.asset_issuer(kind, issuer).alias("issuer"), S.trust_line_asset(kind, code, issuer, F.col("p_brand").cast("binary")).alias("trust_line"),
        S.null_if_empty(F.when(rest == 0, "").otherwise(F.col("p_name"))).alias("not_empty"), S.price_text(F.col("p_size"), F.col("p_partkey")).alias("price"),
    )


@registered(r"""
SELECT doc_id, pos AS event_ordinal, w[1] AS topic_1, w[2] AS topic_2, w[3] AS topic_3, w[4] AS topic_4, len(w)::BIGINT AS n_topics
FROM (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w, 0 AS pos FROM documents WHERE doc_id % 3 < 2
  UNION ALL SELECT doc_id, regexp_extract_all(coalesce(source, ''), '[^ \t-\r]+'), 1 FROM documents WHERE doc_id % 3 = 1
)
""")
def topics_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the events of a transaction: version 3 keeps them in a list of its own, version 4 with its operations,
    and others have none."""
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t-\r]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").withColumn("version", (F.col("doc_id") % 3 + 3).cast("int"))
    own = F.array(words(F.col("text")))
    operations = F.array(F.struct(own.alias("events")), F.struct(F.array(words(F.col("source"))).alias("events")))
    events = docs.select("doc_id", F.posexplode(S.versioned_events(F.col("version"), own, operations)).alias("event_ordinal", "w"))
    return events.select("doc_id", "event_ordinal", *(S.topic(F.col("w"), i).alias(f"topic_{i + 1}") for i in range(4)), F.size("w").cast("bigint").alias("n_topics"))


@registered("""
SELECT event_id, CASE event_type WHEN 'click' THEN event_type || user_id WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END WHEN 'purchase' THEN (user_id::HUGEINT * 18446744073709551616 + event_id)::VARCHAR
  WHEN 'signup' THEN 'void' ELSE '[' || user_id || ',{k:' || event_id || '}]' END AS shown
FROM events
""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    leaf = lambda kind, v: F.concat(F.lit(f'{{"type":"{kind}","v":"'), v, F.lit('"}'))
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", leaf("symbol", F.concat(kind, user)))
        .when(kind == "error", F.concat(F.lit('{"type":"bool","v":'), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("}")))
        .when(kind == "purchase", F.concat(F.lit('{"type":"i128","hi":"'), user, F.lit('","lo":"'), event, F.lit('"}')))
        .when(kind == "signup", F.lit('{"type":"void"}'))
        .otherwise(F.concat(F.lit('{"type":"vec","v":['), leaf("i64", user), F.lit(',{"type":"map","v":[{"key":{"type":"symbol","v":"k"},"val":'), leaf("u64", event), F.lit("}]}]}")))
    )
    return table(spark, sf_dir, "events").select("event_id", S.display(F.parse_json(text)).alias("shown"))


@registered("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"unconditional":true}' WHEN 1 THEN '{"and":[{"abs_before":"' || user_id || '"},{"rel_before":"' || event_id || '"}]}'
  WHEN 2 THEN '{"not":null}' ELSE '{"or":[{"not":{"unconditional":true}},{"abs_before":"' || event_id || '"}]}' END AS predicate
FROM events
""")
def predicate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda kind, c: F.concat(F.lit(f'{{"kind":"{kind}","at":"'), F.col(c).cast("string"), F.lit('"}'))
    rest = F.col("event_id") % 4
    text = (
        F.when(rest == 0, F.lit('{"kind":"unconditional"}'))
        .when(rest == 1, F.concat(F.lit('{"kind":"and","of":['), at("abs_before", "user_id"), F.lit(","), at("rel_before", "event_id"), F.lit("]}")))
        .when(rest == 2, F.lit('{"kind":"not","of":[null]}'))
        .otherwise(F.concat(F.lit('{"kind":"or","of":[{"kind":"not","of":[{"kind":"unconditional"}]},'), at("abs_before", "event_id"), F.lit("]}")))
    )
    return table(spark, sf_dir, "events").select("event_id", S.predicate(F.parse_json(text), 3).alias("predicate"))


def muxed_address(nation: int) -> tuple[str, str, int]:
    """A multiplexed address with a key and an id made from a number, its plain address and its id as a signed one."""
    key, number = bytes([nation]) * 32, nation << 59
    encoded = [base64.b32encode(body + checksum(body)).decode().rstrip("=") for body in (bytes([MUXED_VERSION]) + key + number.to_bytes(8, "big"), bytes([ACCOUNT_VERSION]) + key)]
    return *encoded, number - (number >> 63 << 64)


#: Those of the nations, whose keys are 0 to 24.
MUXED = [muxed_address(n) for n in range(25)]
MUXED_SQL = ", ".join(f"({n}, '{m}', '{base}', {number})" for n, (m, base, number) in enumerate(MUXED))


@registered(f"""
SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN 'G' || c_name WHEN 2 THEN base END AS address_base, CASE c_custkey % 3 WHEN 0 THEN 'M' || c_name WHEN 2 THEN muxed END AS address_muxed,
  CASE c_custkey % 3 WHEN 2 THEN number END AS address_muxed_id
FROM customer JOIN (VALUES {MUXED_SQL}) AS m(nation, muxed, base, number) ON nation = c_nationkey
""")
def address_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiplexed addresses, ones that only claim to be, without a valid check sum, and plain ones."""
    muxed = F.element_at(F.array(*(F.lit(m) for m, _, _ in MUXED)), (F.col("c_nationkey") + 1).cast("int"))
    rest = F.col("c_custkey") % 3
    address = F.when(rest == 2, muxed).otherwise(F.concat(F.when(rest == 0, "M").otherwise("G"), "c_name")).alias("address")
    return split_addresses(table(spark, sf_dir, "customer").select("c_custkey", address), "address").drop("address")


@registered("""
SELECT s AS o_orderkey FROM (SELECT unnest(generate_series((SELECT min(o_orderkey) FROM orders), (SELECT max(o_orderkey) FROM orders))) AS s) WHERE s NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 3) ORDER BY s LIMIT 500
""")
def missing_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    low, high = gaps.bounds(orders, "o_orderkey").first()
    return gaps.missing(orders.filter("o_orderkey % 7 <> 3"), "o_orderkey", low, high)


@registered("""
SELECT min(o_orderkey) AS range_start, max(o_orderkey) AS range_end FROM (SELECT o_orderkey, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS island FROM orders WHERE o_orderkey % 7 NOT IN (3, 4)) GROUP BY island
""")
def contiguous_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.contiguous_ranges(table(spark, sf_dir, "orders").filter("o_orderkey % 7 NOT IN (3, 4)"), "o_orderkey")


@registered("SELECT 'all' AS part, min(o_orderkey) AS min_seq, max(o_orderkey) AS max_seq FROM orders UNION ALL SELECT 'none', 0, 0")
def sequence_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    parts = {"all": orders, "none": orders.filter("o_orderkey < 0")}
    each = [gaps.bounds(df, "o_orderkey").select(F.lit(name).alias("part"), "min_seq", "max_seq") for name, df in parts.items()]
    return each[0].union(each[1])


@registered("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 >= 6")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch that overlaps the table, and holds its rows twice, adds to it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    batch = orders.filter("o_orderkey % 10 >= 4")
    return writes.insert_if_absent(batch.union(batch), orders.filter("o_orderkey % 10 < 6"), ["o_orderkey"])


@registered("""
WITH old AS (SELECT c_custkey, c_mktsegment AS hash, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, c_nationkey AS made FROM customer WHERE c_custkey % 3 <> 0),
new AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment || '-2' END AS hash, CASE WHEN c_custkey % 7 = 0 THEN c_name || '-1' ELSE c_name || '-2' END AS name, c_nationkey + 1 AS made FROM customer WHERE c_custkey % 4 <> 1)
SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.hash ELSE o.hash END AS hash, coalesce(n.name, o.name) AS name, CASE WHEN o.c_custkey IS NOT NULL THEN o.made ELSE n.made END AS made
FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey
""")
def upsert_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals of each key onto a snapshot: overwrite, keep where null, first writer wins."""
    customers = table(spark, sf_dir, "customer")
    key, rank = F.col("c_custkey"), F.col("arrival")
    old = customers.filter("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("hash"), F.when(key % 2 == 0, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("made"))
    twice = customers.filter("c_custkey % 4 <> 1").withColumn("arrival", F.explode(F.array(F.lit(1), F.lit(2))))
    tail = F.concat(F.lit("-"), rank.cast("string"))
    arrivals = twice.select("c_custkey", "arrival", F.when((rank == 2) & (key % 5 == 0), F.lit(None)).otherwise(F.concat("c_mktsegment", tail)).alias("hash"), F.when((rank == 2) & (key % 7 == 0), F.lit(None)).otherwise(F.concat("c_name", tail)).alias("name"), (F.col("c_nationkey") + rank).alias("made"))
    policy = {"overwrite": ["hash"], "keep": ["name"], "first": ["made"]}
    return writes.merge(old, writes.fold(arrivals, "c_custkey", "arrival", **policy), "c_custkey", **policy)


@registered("SELECT p_brand AS wasm_hash, count(DISTINCT p_partkey) AS contract_count FROM part GROUP BY p_brand")
def upsert_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that arrive again and again: the count is of contracts, not of arrivals."""
    parts = table(spark, sf_dir, "part")
    codes = parts.select(F.col("p_brand").alias("wasm_hash"), F.col("p_type").alias("contract_spec"), F.lit(None).cast("string").alias("spec_parsed"), F.lit(None).cast("binary").alias("wasm_bytecode"), F.lit(0).alias("wasm_size"))
    old = codes.filter("wasm_hash < 'Brand#3'").dropDuplicates(["wasm_hash"]).withColumn("contract_count", F.lit(99).cast("bigint"))
    return writes.upsert_codes(old, codes, parts.select(F.col("p_partkey").alias("contract_id"), F.col("p_brand").alias("wasm_hash"))).select("wasm_hash", "contract_count")


@registered("""
SELECT l_orderkey AS transaction_hash, count(*) AS n_lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)) GROUP BY l_orderkey
""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    victim = orders.agg(F.min("o_custkey")).first()[0]
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sequence"))
    transactions = orders.select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("ledger_sequence"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("transaction_hash"))
    return writes.delete_ledger(victim, customers, transactions, lines)[2].groupBy("transaction_hash").agg(F.count("*").alias("n_lines"))


@registered("SELECT 'last_ingested_ledger' AS key, max(o_orderkey)::VARCHAR AS value FROM orders UNION ALL SELECT 'other', '7'")
def forward_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with the newest rows, then one with old rows only."""
    orders = table(spark, sf_dir, "orders")
    state = spark.range(1).select(F.lit("other").alias("key"), F.lit("7").alias("value"), F.current_timestamp().alias("updated_at"))
    for batch in (orders, orders.filter("o_orderkey < 10")):
        state = writes.advance_cursor(state, batch, "o_orderkey")
    return state.select("key", "value")


@registered("SELECT l_orderkey AS key, count(*) AS n_items, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_orderkey")
def summary_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one JSON array each, read back."""
    messages = json_arrays(table(spark, sf_dir, "lineitem"), "l_orderkey", LINE_ORDER, ["l_partkey", "l_quantity"])
    items = F.from_json("value", "array<struct<l_partkey:bigint,l_quantity:double>>")
    return messages.select("key", F.size(items).cast("bigint").alias("n_items"), F.round(F.aggregate(items, F.lit(0.0), lambda a, x: a + x["l_quantity"]), 2).alias("quantity"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")


@registered("""
SELECT c_custkey, count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) = 3 AS has_all FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def has_all_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("names"))
    joined = table(spark, sf_dir, "customer").join(names, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", contracts.has_all(F.col("names"), tuple(p.lower() for p in PRIORITIES)).alias("has_all"))


@registered("""
SELECT 'c' || p_partkey AS contract_id, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS contract_type, CASE WHEN p_size % 2 = 0 THEN lower(hex(p_brand::BLOB)) END AS wasm_hash,
  CASE WHEN p_size % 2 = 0 THEN p_brand >= 'Brand#3' ELSE true END AS is_token, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS name
FROM part WHERE p_partkey % 3 <> 0 AND (p_size % 2 = 1 OR p_brand >= 'Brand#2')
""")
def chained_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as contracts, brands as their code, names as metadata."""
    parts = table(spark, sf_dir, "part").withColumn("contract_id", F.concat(F.lit("c"), F.col("p_partkey").cast("string")))
    detected = parts.select("contract_id", F.col("p_partkey").alias("created_ledger"), F.lit(None).cast("timestamp").alias("created_at"))
    instances = parts.filter("p_partkey % 3 <> 0").select("contract_id", F.when(F.col("p_size") % 2 == 0, contracts.WASM).otherwise("asset").alias("executable_type"), F.col("p_brand").cast("binary").alias("wasm_hash"))
    function = lambda n: F.struct(F.lit("function_v0").alias("kind"), F.lit(n.title()).alias("name"), F.lit("").alias("doc"), F.array().cast("array<struct<name:string,type:string>>").alias("inputs"), F.array().cast("array<string>").alias("outputs"))
    spec = F.array(*map(function, contracts.TOKEN_FUNCTIONS))
    codes = parts.filter("p_brand >= 'Brand#2'").select(F.hex(F.col("p_brand").cast("binary")).alias("h"), "p_brand").distinct().select(F.lower("h").alias("wasm_hash"), F.when(F.col("p_brand") >= "Brand#3", spec).otherwise(F.slice(spec, 1, 4)).alias("spec"))
    metadata = parts.filter("p_partkey % 2 = 0").select("contract_id", F.col("p_name").alias("name"), F.lit(None).cast("string").alias("symbol"), F.lit(7).alias("decimals"))
    found = contracts.contract_rows(detected, instances, codes, metadata)
    return found.select("contract_id", F.col("contract_type").cast("int").alias("contract_type"), "wasm_hash", "is_token", "name")


@registered("""
SELECT lower(hex(event_type::BLOB)) AS contract_id, event_id AS created_ledger FROM events WHERE event_type IN ('click', 'view') AND user_id % 2 = 0
UNION ALL SELECT lower(hex('op'::BLOB)), event_id FROM events WHERE event_id % 5 = 0
""")
def new_entities_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(kind: Column, key: Column, id_: Column) -> Column:
        return F.struct(kind.alias("change_type"), F.lit("contract_data").alias("entry_type"), F.lit("contract").alias("contract_type"), id_.alias("contract_id"), key.alias("key_type"))

    events = table(spark, sf_dir, "events")
    own = change(F.when(F.col("event_type").isin("click", "view"), "created").otherwise("updated"), F.when(F.col("user_id") % 2 == 0, "instance").otherwise("balance"), F.col("event_type").cast("binary"))
    inner = change(F.lit("created"), F.lit("instance"), F.when(F.col("event_id") % 5 == 0, F.lit("op").cast("binary")))
    meta = F.struct(F.array(own).alias("tx_changes_after"), F.array(F.struct(F.array(inner).alias("changes"))).alias("operations"))
    return contracts.detect(events.select(F.col("event_id").alias("ledger"), F.lit(0).alias("created_at"), meta.alias("meta"))).select("contract_id", "created_ledger")


@registered("""
SELECT o_custkey, o_orderkey, rank_in_key FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INTEGER AS rank_in_key FROM orders) WHERE rank_in_key <= 5
""")
def newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.newest_by_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", 5, ["o_orderkey"]).select("o_custkey", "o_orderkey", "rank_in_key")


@registered("""
SELECT tip, last, greatest(tip - last, 0) AS behind, last_day < tip_day - INTERVAL 30 DAY AS stale
FROM (SELECT max(o_orderkey) AS tip, max(o_orderkey) FILTER (o_orderkey % 10 < 5 AND o_orderdate < TIMESTAMP '1996-01-01') AS last, max(o_orderdate) AS tip_day, max(o_orderdate) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS last_day FROM orders)
""")
def lag_and_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    done = orders.filter("o_orderdate < timestamp_ntz'1996-01-01'")
    lag = rollups.lag_behind(orders, done.filter("o_orderkey % 10 < 5"), "o_orderkey")
    days = orders.agg(F.max("o_orderdate").alias("tip_day")).crossJoin(done.agg(F.max("o_orderdate").alias("last_day")))  # one row each
    return lag.crossJoin(days.select(rollups.is_stale(F.col("last_day"), F.col("tip_day"), "30 days").alias("stale")))


@registered("""
WITH days AS (SELECT o_orderdate::DATE AS day, count(*) AS n_day, round(avg(o_totalprice), 7) AS avg_fee, round(count(*) FILTER (o_orderpriority = '1-URGENT') * 100 / count(*), 2)::DOUBLE AS flag_share FROM orders GROUP BY 1),
gaps AS (SELECT o_orderdate::DATE AS day, round(avg(gap), 2) AS avg_close_seconds FROM (SELECT o_orderdate, epoch(o_orderdate) - epoch(lag(o_orderdate) OVER (ORDER BY o_orderkey)) AS gap FROM orders) GROUP BY 1)
SELECT day::VARCHAR AS day, n_day, avg_fee, flag_share, sum(n_day) OVER (ORDER BY day)::BIGINT AS n_total, avg_close_seconds FROM days LEFT JOIN gaps USING (day)
""")
def daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    stats = rollups.network_stats(orders, orders, sequence="o_orderkey", closed_at="o_orderdate", time="o_orderdate", fee="o_totalprice", flag=F.col("o_orderpriority") == "1-URGENT", bucket=1000)
    return stats.select(F.col("day").cast("string").alias("day"), "n_day", F.round("avg_fee", 7).alias("avg_fee"), F.col("flag_share").cast("double").alias("flag_share"), "n_total", F.round("avg_close_seconds", 2).alias("avg_close_seconds"))


@registered("""
SELECT c_custkey AS contract_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS event_count, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = 0) AS invocation_count FROM customer
""")
def contract_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract_ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contract_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("contract_id"))
    return rollups.contract_activity(contract_ids, orders, orders.select(F.when(F.col("o_orderkey") % 2 == 0, F.col("contract_id")).alias("contract_id")))


@registered("""
SELECT event_id, user_id AS contract_id, event_type AS topic_1 FROM events WHERE user_id = (SELECT min(user_id) FROM events) AND event_type = 'click' ORDER BY ts DESC, event_id, user_id, event_type LIMIT 20
""")
def newest_by_contract_and_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("user_id")).first()[0]
    rows = events.select("event_id", F.col("user_id").alias("contract_id"), F.col("event_type").alias("topic_1"), F.col("ts").alias("created_at"))
    return rollups.newest_where(rows, "contract_events", {"contract_id": first, "topic_1": "click"}).drop("created_at")


@registered("""
SELECT c_nationkey, c_custkey, c_acctbal, r AS rank_in_group FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS r FROM customer) WHERE r <= 10
""")
def rich_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rich_list(table(spark, sf_dir, "customer"), group="c_nationkey", amount="c_acctbal", n=10, ties=["c_custkey"]).select("c_nationkey", "c_custkey", "c_acctbal", "rank_in_group")


@registered("""
SELECT event_type, ts::DATE::VARCHAR AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n_trades FROM events GROUP BY 1, ts::DATE
""")
def pair_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.ohlc(table(spark, sf_dir, "events"), pair=["event_type"], time="ts", price="value", tie="event_id").withColumn("day", F.col("day").cast("string"))


@registered("SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['small', 'ring'])")
def label_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.label_search(table(spark, sf_dir, "part"), "p_name", ["Small", "ring"]).select("p_partkey", "p_name")


@registered("SELECT event_id, repeat('[', (event_id % 10)::INTEGER) || 'e' || event_id || repeat(',a]', (event_id % 10)::INTEGER) AS shown FROM events")
def deep_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of up to nine levels; those over six are taken apart, level by level inside their row."""
    levels = (F.col("event_id") % 10).cast("int")
    text = F.concat(F.repeat(F.lit('{"type":"vec","v":['), levels), F.lit('{"type":"symbol","v":"e'), "event_id", F.lit('"}'), F.repeat(F.lit(',{"type":"symbol","v":"a"}]}'), levels))
    # a split of a file has many ids, and each id is much work
    ids = table(spark, sf_dir, "events").select("event_id").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")
    values = ids.select("event_id", F.array(F.parse_json(text)).alias("values"))
    rows = values.withColumn("shown", F.transform("values", lambda v: S.display(v)))
    return trees.complete(rows, F.col("values"), "shown", trees.VALUES).select("event_id", F.element_at("shown", 1).alias("shown"))


@registered("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'small') AND len(list_filter(string_split(lower(p_name), ' '), lambda w: starts_with(w, 'r'))) > 0")
def label_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of two terms, one of them the beginning of a word, by postings."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    entries = label_index.postings(parts, "p_partkey", "p_name")
    wanted = label_index.matching(label_index.terms_table(spark, ["Small", "r*"]), entries.select("word").distinct())
    return parts.join(label_index.found(entries, wanted, 2).withColumnRenamed("id", "p_partkey"), "p_partkey", "left_semi")


MOVES_SQL = """
moves AS (SELECT CASE event_type WHEN 'click' THEN 'mint' WHEN 'error' THEN 'burn' WHEN 'purchase' THEN 'clawback' ELSE 'transfer' END AS kind, event_id % 7 AS code, round(value * 100)::BIGINT AS amount,
  CASE WHEN event_type NOT IN ('click') THEN user_id END AS from_, CASE WHEN event_type NOT IN ('error', 'purchase') THEN event_id % 50 END AS to_ FROM events)
"""


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "click", "mint").when(kind == "error", "burn").when(kind == "purchase", "clawback").otherwise("transfer")
    return table(spark, sf_dir, "events").select(
        name.alias("event_type_name"), (F.col("event_id") % 7).cast("string").alias("asset_code"), F.lit("issuer").alias("asset_issuer"), F.round(F.col("value") * 100).cast("bigint").alias("amount"),
        F.when(kind != "click", F.col("user_id")).alias("from_address"), F.when(~kind.isin("error", "purchase"), F.col("event_id") % 50).alias("to_address"),
    )


@registered(f"WITH {MOVES_SQL} SELECT code::VARCHAR AS asset_code, sum(CASE kind WHEN 'mint' THEN amount WHEN 'transfer' THEN 0 ELSE -amount END)::BIGINT AS supply FROM moves GROUP BY 1")
def asset_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.asset_supply(moves(spark, sf_dir)).select("asset_code", "supply")


@registered(f"""
WITH {MOVES_SQL}, b AS (SELECT code, holder, sum(amount) AS balance FROM (SELECT code, to_ AS holder, amount FROM moves UNION ALL SELECT code, from_, -amount FROM moves) WHERE holder IS NOT NULL GROUP BY 1, 2)
SELECT code::VARCHAR AS asset_code, count(*) AS holder_count FROM b WHERE balance > 0 GROUP BY 1
""")
def asset_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.holders(rollups.balances(moves(spark, sf_dir))).select("asset_code", "holder_count")


@registered("""
SELECT p_partkey AS offer_id, p_brand AS selling, p_type AS buying, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size::DECIMAL(20,0) / (p_partkey % 9 + 1), p_partkey)::INTEGER AS place FROM part
""")
def offer_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("offer_id"), F.col("p_brand").alias("selling"), F.col("p_type").alias("buying"), F.col("p_size").alias("price_n"), (F.col("p_partkey") % 9 + 1).alias("price_d"))
    return rollups.offer_book(offers, buckets=4).select("offer_id", "selling", "buying", "place")


@registered("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey + 100 < 1000")
def expiring_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") + 100).alias("ttl_ledger"))
    return rollups.expiring(storage, 1000).select("o_orderkey")


@registered("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2")
def rows_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rows_by_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@registered("SELECT o_custkey, count(*) AS n_events FROM orders WHERE o_orderkey BETWEEN 100 AND 9000 GROUP BY 1")
def range_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.activity(landing.ledger_range(table(spark, sf_dir, "orders"), 100, 9000, "o_orderkey"), "o_custkey", "n_events")


@registered("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return landing.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey")
