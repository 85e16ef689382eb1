"""Operations and events that no registered query covers: strict-receive payments, trust lines, claimable balances, and events that are left out."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspring.functions.operations import BODY, details, promoted
from tallyspring.operators import builders
from tallyspring.schemas import TRANSACTIONS_RAW

COIN, HOME = {"kind": "issued", "code": "ABCDEF", "issuer": "GOWNER"}, {"kind": "native"}
TREE = {"kind": "and", "of": [{"kind": "unconditional"}, {"kind": "not", "of": [{"kind": "abs_before", "at": 77}]}]}

CASES = {
    "path_payment_strict_receive": (
        {"destination": {"base": "GTO", "muxed": "MTO", "muxed_id": 9}, "dest_amount": 31, "dest_asset": COIN, "send_asset": HOME, "send_max": 40},
        {"destination": "MTO", "dest_amount": "31", "dest_asset": "ABCDEF:GOWNER", "send_asset": "native", "send_max": "40"},
        {"destination": "GTO", "destination_muxed": "MTO", "destination_muxed_id": 9, "amount": 31, "asset_code": "ABCDEF", "asset_issuer": "GOWNER"},
    ),
    "change_trust": ({"limit": 900}, {"limit": "900"}, {}),
    "create_claimable_balance": (
        {"asset": COIN, "amount": 12, "claimants": [{"destination": "GONE", "predicate": TREE}, {"destination": "GTWO", "predicate": {"kind": "rel_before", "at": 5}}]},
        {"asset": "ABCDEF:GOWNER", "amount": "12", "claimants": [{"destination": "GONE", "predicate": {"and": [{"unconditional": True}, {"not": {"abs_before": "77"}}]}}, {"destination": "GTWO", "predicate": {"rel_before": "5"}}]},
        {"amount": 12, "asset_code": "ABCDEF", "asset_issuer": "GOWNER"},
    ),
}


@pytest.mark.parametrize("kind", sorted(CASES))
def test_details_and_columns(spark, kind):
    body, expected, columns = CASES[kind]
    df = spark.range(1).select(F.lit(kind).alias("name"), F.from_json(F.lit(json.dumps({"b": body})), f"b {BODY}")["b"].alias("b"))
    row = df.select(details(F.col("name"), F.col("b")).alias("d"), *(c.alias(n) for n, c in promoted(F.col("name"), F.col("b")).items())).first().asDict()
    assert json.loads(row.pop("d")) == {"type": kind} | expected
    assert {k: v for k, v in row.items() if v is not None} == columns


def test_events_without_a_contract_or_with_another_body_are_left_out(spark):
    event = lambda contract, version: (contract, 1, version, [("x", None)], ("y", None))
    events = [event(b"\x0a", 0), event(None, 0), event(b"\x0b", 1), event(b"\x0c", None), event(b"\x0d", 0)]
    row = (4, 1, "SUCCESS", False, 1700000000, b"p", ("G1", None, None), 1, 100, ("tx_success", 1), (0, None, None, None), [], (3, None, events, None), "e", "r", "m")
    good, bad = builders.contract_event_table(spark.createDataFrame([row], TRANSACTIONS_RAW), F.lit(bytearray(b"n")))
    # those that stay keep their place among all events of the transaction
    assert sorted((r["contract_id"], r["event_ordinal"]) for r in good.collect()) == [("0a", 0), ("0d", 4)] and bad.count() == 0
