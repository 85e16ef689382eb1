"""Landing fixtures and the rows expected from them."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tallyspring.functions import scalars as S
from tallyspring.functions.addresses import split_addresses
from tallyspring.functions.operations import BODY, details, promoted
from tallyspring.operators import builders, contracts, gaps, writes
from tallyspring.schemas import CODES, INSTANCES, LEDGERS_RAW, TOKEN_METADATA

ISSUER = "GA5ZSEJYB37JRC5AVCIA5MOP4RHTM335X2KGX3IHOJAPP5RE34K4KZVN"
CLAIMANT = "GBRPYHIL2CI3FNQ4BXLFMNDLFJUNPU2HY3ZMFSHONUCEOASW7QC7OX2H"
USDC, NATIVE = {"kind": "issued", "code": "USDC", "issuer": ISSUER}, {"kind": "native"}
ASSET = f"USDC:{ISSUER}"
BALANCE, POOL = bytes.fromhex("ab" * 32), bytes.fromhex("cd" * 32)


def price(n, d):
    return {"n": n, "d": d}


CASES = [
    ("manage_sell_offer", {"selling": NATIVE, "buying": USDC, "amount": 1000000000, "price": price(12, 100), "offer_id": 42}, {"selling": "native", "buying": ASSET, "amount": "1000000000", "price": "12/100", "offer_id": "42"}, (1000000000, "XLM", None)),
    ("manage_buy_offer", {"selling": USDC, "buying": NATIVE, "buy_amount": 500000000, "price": price(1, 5), "offer_id": 7}, {"selling": ASSET, "buying": "native", "buy_amount": "500000000", "price": "1/5", "offer_id": "7"}, (500000000, "USDC", ISSUER)),
    ("create_passive_sell_offer", {"selling": NATIVE, "buying": USDC, "amount": 250000000, "price": price(3, 10), "offer_id": 9}, {"selling": "native", "buying": ASSET, "amount": "250000000", "price": "3/10"}, (250000000, "XLM", None)),
    ("claim_claimable_balance", {"balance_type": 0, "balance_hash": BALANCE}, {"balance_id": "00000000" + "ab" * 32}, (None, None, None)),
    ("begin_sponsoring_future_reserves", {"sponsored_id": ISSUER}, {"sponsored_id": ISSUER}, (None, None, None)),
    ("end_sponsoring_future_reserves", {}, {}, (None, None, None)),
    ("revoke_sponsorship", {"sponsorship": {"kind": "account", "account_id": ISSUER}}, {"sponsorship_type": "account", "account_id": ISSUER}, (None, None, None)),
    ("revoke_sponsorship", {"sponsorship": {"kind": "claimable_balance", "balance_type": 0, "balance_hash": BALANCE}}, {"sponsorship_type": "claimable_balance", "claimable_balance_id": "00000000" + "ab" * 32}, (None, None, None)),
    ("revoke_sponsorship", {"sponsorship": {"kind": "trustline", "account_id": ISSUER, "asset": USDC}}, {"sponsorship_type": "trustline", "account_id": ISSUER, "trustline_asset": ASSET}, (None, None, None)),
    ("revoke_sponsorship", {"sponsorship": {"kind": "trustline", "account_id": ISSUER, "asset": {"kind": "pool_share"}, "pool": POOL}}, {"sponsorship_type": "trustline", "account_id": ISSUER, "trustline_asset": "liquidity_pool:" + "cd" * 32}, (None, None, None)),
    ("revoke_sponsorship", {"sponsorship": {"kind": "offer", "account_id": ISSUER, "offer_id": 12345}}, {"sponsorship_type": "offer", "account_id": ISSUER, "offer_id": "12345"}, (None, None, None)),
    ("revoke_sponsorship", {"sponsorship": {"kind": "data", "account_id": ISSUER, "data_name": "config.setting"}}, {"sponsorship_type": "data", "account_id": ISSUER, "data_name": "config.setting"}, (None, None, None)),
    ("revoke_sponsorship", {"sponsorship": {"kind": "liquidity_pool", "pool": POOL}}, {"sponsorship_type": "liquidity_pool", "liquidity_pool_id": "cd" * 32}, (None, None, None)),
    ("revoke_sponsorship", {"sponsorship": {"kind": "contract_code", "key_type": "LedgerEntryTypeContractCode"}}, {"sponsorship_type": "unknown", "ledger_key_type": "LedgerEntryTypeContractCode"}, (None, None, None)),
    ("revoke_sponsorship", {"sponsorship": {"kind": "signer", "account_id": ISSUER, "signer_key": CLAIMANT}}, {"sponsorship_type": "signer", "signer_account_id": ISSUER, "signer_key": CLAIMANT}, (None, None, None)),
    ("liquidity_pool_deposit", {"pool_id": POOL, "max_amount_a": 1000000000, "max_amount_b": 2000000000, "min_price": price(1, 2), "max_price": price(2, 1)}, {"liquidity_pool_id": "cd" * 32, "max_amount_a": "1000000000", "max_amount_b": "2000000000", "min_price": "1/2", "max_price": "2/1"}, (None, None, None)),
    ("liquidity_pool_withdraw", {"pool_id": POOL, "amount": 500000000, "min_amount_a": 100000000, "min_amount_b": 200000000}, {"liquidity_pool_id": "cd" * 32, "amount": "500000000", "min_amount_a": "100000000", "min_amount_b": "200000000"}, (500000000, None, None)),
    ("extend_footprint_ttl", {"extend_to": 100000}, {"extend_to": "100000"}, (None, None, None)),
    ("restore_footprint", {}, {}, (None, None, None)),
    ("bump_sequence", {"amount": 3}, {}, (None, None, None)),
    ("payment", {"destination": {"base": CLAIMANT, "muxed": "M1", "muxed_id": 2**64 - 1}, "amount": 5, "asset": USDC}, {"destination": "M1", "amount": "5", "asset": ASSET}, (5, "USDC", ISSUER)),
    ("path_payment_strict_send", {"destination": {"base": CLAIMANT}, "send_amount": 7, "send_asset": NATIVE, "dest_asset": USDC, "dest_min": 6}, {"destination": CLAIMANT, "send_amount": "7", "send_asset": "native", "dest_asset": ASSET, "dest_min": "6"}, (7, "XLM", None)),
    ("invoke_host_function", {"function_type": "HostFunctionTypeInvoke"}, {"function_type": "HostFunctionTypeInvoke"}, (None, None, None)),
]


def rows_with_body(spark, cases):
    from pyspark.sql import types as T

    body = T.StructType.fromDDL(f"b {BODY}")["b"].dataType

    def full(value, kind):
        if isinstance(kind, T.StructType) and value is not None:
            return tuple(full(value.get(f.name), f.dataType) for f in kind.fields)
        return value

    from decimal import Decimal

    def fixed(fields):
        d = fields.get("destination")
        return fields | {"destination": d | {"muxed_id": Decimal(d["muxed_id"])}} if d and d.get("muxed_id") else fields

    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("b", body)])
    return spark.createDataFrame([(i, name, full(fixed(fields), body)) for i, (name, fields) in enumerate(cases)], schema)


def test_details_and_promoted_columns(spark):
    df = rows_with_body(spark, [(n, b) for n, b, _, _ in CASES])
    name, body = F.col("name"), F.col("b")
    found = {r["i"]: r for r in df.select("i", details(name, body).alias("d"), *(c.alias(n) for n, c in promoted(name, body).items())).collect()}
    for i, (kind, _, expected, columns) in enumerate(CASES):
        assert json.loads(found[i]["d"]) == {"type": kind} | expected
        assert (found[i]["amount"], found[i]["asset_code"], found[i]["asset_issuer"]) == columns
    paid = next(found[i] for i, c in enumerate(CASES) if c[0] == "payment")
    assert (paid["destination"], paid["destination_muxed"], paid["destination_muxed_id"]) == (CLAIMANT, "M1", -1)


@pytest.mark.parametrize(
    ("tree", "expected"),
    [
        ({"kind": "unconditional"}, {"unconditional": True}),
        ({"kind": "and", "of": [{"kind": "abs_before", "at": 1700000000}, {"kind": "rel_before", "at": 86400}]}, {"and": [{"abs_before": "1700000000"}, {"rel_before": "86400"}]}),
        ({"kind": "or", "of": [{"kind": "unconditional"}, {"kind": "abs_before", "at": 1}]}, {"or": [{"unconditional": True}, {"abs_before": "1"}]}),
        ({"kind": "not", "of": [{"kind": "unconditional"}]}, {"not": {"unconditional": True}}),
        ({"kind": "not", "of": [None]}, {"not": None}),
        ({"kind": "odd"}, {"unknown": True}),
    ],
)
def test_predicates(spark, tree, expected):
    text = spark.range(1).select(S.predicate(F.parse_json(F.lit(json.dumps(tree)))).alias("p")).first()["p"]
    assert json.loads(text) == expected


def test_too_deep_predicate_is_null(spark):
    tree = {"kind": "unconditional"}
    for _ in range(4):
        tree = {"kind": "not", "of": [tree]}
    df = spark.range(1).select(F.parse_json(F.lit(json.dumps(tree))).alias("v"))
    assert df.select(S.predicate(F.col("v"), 3)).first()[0] is None and df.select(S.predicate(F.col("v"), 4)).first()[0]


def test_scalars(spark):
    row = spark.range(1).select(
        S.parse_time(F.lit("1700000000")).alias("epoch"), S.parse_time(F.lit("2024-01-01T00:00:00Z")).alias("iso"), S.parse_time(F.lit("2024 or so")).alias("bad"), S.snake_case(F.lit("ManageSellOffer")).alias("snake"),
        S.type_name(F.lit("OperationType"), F.lit(99)).alias("unknown"), S.wrapped_long(F.lit("9223372036854775808").cast("decimal(20,0)")).alias("wrapped"), S.json_string(F.lit('a"b\n')).alias("json"), S.trimmed_code(F.lit("AB\0\0")).alias("code"),
    ).first()
    utc = datetime.datetime.fromtimestamp
    assert row["epoch"] == utc(1700000000) and row["iso"] == utc(1704067200) and row["bad"] is None
    assert (row["snake"], row["unknown"], row["wrapped"], json.loads(row["json"]), row["code"]) == ("manage_sell_offer", "unknown_99", -(2**63), 'a"b\n', "AB")


def test_display(spark):
    values = [({"type": "symbol", "v": "transfer"}, "transfer"), ({"type": "bool", "v": True}, "true"), ({"type": "void"}, "void"), ({"type": "address", "v": ISSUER}, ISSUER), ({"type": "i64", "v": 42}, "42"), ({"type": "i128", "hi": 1, "lo": 5}, str(2**64 + 5)), ({"type": "bytes", "v": "0a"}, "0x0a"), ({"type": "vec", "v": [{"type": "void"}, {"type": "i64", "v": 1}]}, "[void,1]"), ({"type": "timepoint", "code": 7}, "scval_type_7")]
    for value, expected in values:
        assert spark.range(1).select(S.display(F.parse_json(F.lit(json.dumps(value))))).first()[0] == expected


def test_muxed_addresses(spark):
    muxed = "MA7QYNF7SOWQ3GLR2BGMZEHXAVIRZA4KVWLTJJFC7MGXUA74P7UJVAAAAAAAAAAAAAJLK"
    rows = {r["a"]: r for r in split_addresses(spark.createDataFrame([(muxed,), (ISSUER,), (None,), ("Mbroken",)], "a string"), "a").collect()}
    assert tuple(rows[muxed])[1:] == ("GA7QYNF7SOWQ3GLR2BGMZEHXAVIRZA4KVWLTJJFC7MGXUA74P7UJVSGZ", muxed, -(2**63))
    assert tuple(rows[ISSUER])[1:] == (ISSUER, None, None) and tuple(rows[None])[1:] == (None, None, None) and rows["Mbroken"]["a_base"] is None


def token(kind, from_=None, to=None, amount="5", asset=None, contract=None, op=None):
    return (kind, from_, to, amount, asset, contract, "tx", op, datetime.datetime(2023, 11, 14), None)


def test_token_events(spark):
    usdc = ("issued", "USDC", "GISSUER")
    native = ("native", None, None)
    events = [token("transfer", "GABC", "GDEF", "5000000", native, None, 1), token("mint", None, "GXYZ", "100000000000", usdc), token("transfer", "GA", "GB", "1", None, "CABC123XYZ"), token("fee", "GABC", None, "100", native), token("transfer", "BABC", "G", asset=native), token("transfer", None, "BABC", asset=native), token("transfer", "M" * 70, "G", asset=native), token("mint", None, "G", "9" * 39, usdc)]
    good, bad = builders.token_event_table(spark.createDataFrame([(100, "h", "1700000000", None, None, events), (101, "h", "1", None, None, [])], LEDGERS_RAW))
    rows = [tuple(r) for r in good.orderBy("event_ordinal").select("event_type", "asset_type", "from_address", "to_address", "asset_code", "asset_contract_id", "operation_index", "ledger_sequence").collect()]
    assert rows == [(0, 0, "GABC", "GDEF", None, None, 1, 100), (1, 1, None, "GXYZ", "USDC", None, None, 100), (0, 2, "GA", "GB", None, "CABC123XYZ", None, 100), (4, 0, "GABC", None, None, None, None, 100)]
    assert sorted(r["reason"] for r in bad.collect()) == ["amount", "from_address"]


@pytest.mark.parametrize(("ids", "expected"), [([], []), ([42], [(42, 42)]), ([100, 101, 102, 103], [(100, 103)]), ([100, 101, 105, 200, 201, 202], [(100, 101), (105, 105), (200, 202)]), ([1, 3, 5, 7], [(1, 1), (3, 3), (5, 5), (7, 7)]), (list(range(90, 320)), [(90, 319)])])
def test_contiguous_ranges(spark, ids, expected):
    found = gaps.contiguous_ranges(spark.createDataFrame([(i,) for i in ids], "id bigint"), "id", bucket=100)
    assert sorted(map(tuple, found.collect())) == expected


def test_missing(spark):
    full = spark.range(97000000, 97000020).withColumnRenamed("id", "sequence")
    assert gaps.missing(full, "sequence", 97000000, 97000019).count() == 0
    holes = full.filter(~F.col("sequence").isin(97000003, 97000004, 97000010))
    assert [r[0] - 97000000 for r in gaps.missing(holes, "sequence", 97000000, 97000019).collect()] == [3, 4, 10]
    assert gaps.missing(holes, "sequence", 97000000, 97000019, 2).count() == 2
    assert gaps.missing(holes, "sequence", 5, 4).count() == gaps.missing(holes, "sequence", 1, 9, 0).count() == 0


def test_merge_in_two_batches_equals_one(spark):
    rows = [(k, n, None if (k + n) % 3 == 0 else f"a{n}", None if n % 2 else f"b{n}", f"c{n}") for k in range(5) for n in range(6)]
    schema = "k int, n int, over string, keep string, first string"
    policy = {"overwrite": ["over"], "keep": ["keep"], "first": ["first"]}
    every = spark.createDataFrame(rows, schema)
    empty = every.limit(0).drop("n")
    one = writes.merge(empty, writes.fold(every, "k", "n", **policy), "k", **policy)
    two = empty
    for part in ("n < 3", "n >= 3"):
        two = writes.merge(two, writes.fold(every.filter(part), "k", "n", **policy), "k", **policy)
    plain = {}
    for k, _, over, keep, first in rows:
        old = plain.get(k, (None, None, first))
        plain[k] = (over, keep or old[1], old[2])
    assert {r["k"]: (r["over"], r["keep"], r["first"]) for r in one.collect()} == {r["k"]: (r["over"], r["keep"], r["first"]) for r in two.collect()} == plain


def test_contract_classes(spark):
    def spec(*names):
        return [("function_v0", n, "", [], []) for n in names]

    specs = {"00": spec("transfer", "balance", "decimals", "name", "symbol"), "01": spec("Transfer", "BALANCE", "Decimals", "Name", "symbol"), "02": spec("transfer", "balance", "decimals", "name"), "03": spec("owner_of", "token_uri", "transfer"), "04": [], "05": None}
    codes = spark.createDataFrame([(h, b"x", None, s) for h, s in specs.items()], CODES)
    ids = [*specs, "missing_code", "no_instance", "asset"]
    detected = spark.createDataFrame([(c, 1, None) for c in ids], "contract_id string, created_ledger bigint, created_at timestamp")
    instances = spark.createDataFrame([(c, "asset" if c == "asset" else "wasm", None if c == "asset" else bytes.fromhex(c) if c in specs else b"\xff") for c in ids if c != "no_instance"], INSTANCES)
    metadata = spark.createDataFrame([("00", "USDC", "USDC", 7)], TOKEN_METADATA)
    found = {r["contract_id"]: r for r in contracts.contract_rows(detected, instances, codes, metadata).collect()}
    assert {c: (r["is_token"], r["is_nft"]) for c, r in found.items()} == {"00": (True, False), "01": (True, False), "02": (False, False), "03": (False, True), "04": (False, False), "05": (False, False), "asset": (True, False)}
    assert (found["00"]["name"], found["00"]["decimals"], found["01"]["name"]) == ("USDC", 7, None)
