"""Values and predicates of any depth are shown; those with a part that can't be shown are null, and their rows go to quarantine."""

import json

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspring.functions import scalars as S
from tallyspring.operators import builders, trees
from tallyspring.schemas import TRANSACTIONS_RAW
from tallyspring.streaming import ingest

SYMBOL = {"type": "symbol", "v": "a"}
WIDE = {"type": "i128", "hi": str(2**63 - 1), "lo": "0"}


def nested(depth, kind="vec"):
    value = SYMBOL
    for _ in range(depth):
        value = {"type": "vec", "v": [value, SYMBOL]} if kind == "vec" else {"type": "map", "v": [{"key": SYMBOL, "val": value}]}
    return value


def denied(depth, tree=None):
    tree = tree or {"kind": "unconditional"}
    for _ in range(depth):
        tree = {"kind": "not", "of": [tree]}
    return tree


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (nested(4), "[[[[a,a],a],a],a]"),
        (nested(6, "map"), "{a:" * 6 + "a" + "}" * 6),
        (nested(7), None),
        (nested(7, "map"), None),
        ({"type": "vec", "v": [WIDE, SYMBOL]}, None),
        ({"type": "map", "v": [{"key": SYMBOL, "val": WIDE}, {"key": SYMBOL, "val": SYMBOL}]}, None),
        ({"type": "map", "v": [{"key": SYMBOL, "val": nested(1)}, {"key": nested(1), "val": SYMBOL}]}, "{a:[a,a],[a,a]:a}"),
        ({"type": "vec", "v": []}, "[]"),
        ({"type": "map", "v": []}, "{}"),
    ],
)
def test_display_is_whole_or_null(spark, value, expected):
    assert spark.range(1).select(S.display(F.parse_json(F.lit(json.dumps(value))))).first()[0] == expected


def shown(value):
    """The text of a value, by recursion; None if a part can't be shown."""
    if value["type"] == "symbol":
        return value["v"]
    if value["type"] == "i128":
        return None
    sides = [x for item in value["v"] for x in (item["key"], item["val"])] if value["type"] == "map" else value["v"]
    texts = [shown(x) for x in sides]
    if None in texts:
        return None
    if value["type"] == "vec":
        return f"[{','.join(texts)}]"
    return "{" + ",".join(f"{k}:{v}" for k, v in zip(texts[::2], texts[1::2], strict=True)) + "}"


def landing(spark):
    event = lambda topic, value: {"contract_id": "CgsM", "type": 1, "body_v": 0, "topics": [{"xdr": "t", "val": topic}], "data": {"xdr": "d", "val": value}}
    create = lambda tree: {"type": 14, "type_name": "OperationTypeCreateClaimableBalance", "body": {"amount": 5, "claimants": [{"destination": "G2", "predicate": tree}]}}
    events = [event(nested(4), SYMBOL), event(nested(7), SYMBOL), event(SYMBOL, nested(9)), event(SYMBOL, {"type": "vec", "v": [WIDE]}), event(nested(9, "map"), buried(9)), event(nested(7), SYMBOL)]
    row = {"ledger": 5, "application_order": 1, "created_at": 1700000000, "hash_payload": "cGF5", "source": {"base": "G1"}, "result": {"code": "tx_success", "fee_charged": 1}, "operations": [create(denied(6)), create(denied(8)), create(denied(8, {"kind": "not"}))], "meta": {"v": 3, "v3_events": events}}
    # the transaction twice: rows that repeat aren't mixed up
    return spark.createDataFrame([(json.dumps(row),)] * 2, "j string").select(F.from_json("j", TRANSACTIONS_RAW).alias("r")).select("r.*")


def buried(depth):
    """A number too wide to show under lists."""
    value = WIDE
    for _ in range(depth):
        value = {"type": "vec", "v": [SYMBOL, value]}
    return value


def test_deep_events_are_shown(spark):
    good, bad = builders.contract_event_table(landing(spark), F.lit(bytearray(b"network")), DataFrame.persist)
    rows = sorted((r["event_ordinal"], r["topic_1"], r["value_decoded"]) for r in good.collect())
    a = '"a"'
    expected = [(0, "[[[[a,a],a],a],a]", a), (1, shown(nested(7)), a), (2, "a", json.dumps(shown(nested(9)))), (5, shown(nested(7)), a)]
    assert rows == sorted(expected * 2)
    assert sorted((r["event_ordinal"], r["reason"]) for r in bad.collect()) == [(3, "value")] * 2 + [(4, "value")] * 2
    told = ingest.quarantined({"contract_events": bad}).orderBy("row").collect()
    assert len(told) == 4 and all('"symbol"' in r["row"] for r in told)


def test_deep_predicates_are_shown(spark):
    good, bad = builders.operation_table(landing(spark), F.lit(bytearray(b"network")), DataFrame.persist)
    told = sorted((r["application_order"], json.loads(r["details"])["claimants"][0]["predicate"]) for r in good.collect() if r["application_order"] == 2)
    tree = {"unconditional": True}
    for _ in range(8):
        tree = {"not": tree}
    assert told == [(2, tree)] * 2
    assert sorted(r["application_order"] for r in good.collect()) == [1, 1, 2, 2]
    assert [(r["pos"], r["reason"]) for r in bad.collect()] == [(2, "predicate")] * 2  # without operands
    assert '"predicate"' in ingest.quarantined({"operations": bad}).first()["row"]


def test_a_tree_of_fifty_levels(spark):
    many = {"type": "map", "v": [{"key": nested(50), "val": SYMBOL}, {"key": SYMBOL, "val": nested(3, "map")}]}
    trees_in = {"long": many, "hidden": buried(12), "flat": SYMBOL, "none": {"type": "vec", "v": []}}
    roots = spark.createDataFrame([(k, json.dumps(v)) for k, v in trees_in.items()], "key string, j string").select("key", F.parse_json("j").alias("v"))
    assert {r["key"]: r["text"] for r in trees.whole_texts(roots, trees.VALUES, DataFrame.persist).collect()} == {k: shown(v) for k, v in trees_in.items()}


def test_mixed_predicates(spark):
    def tree(n):
        return {"kind": "unconditional"} if n == 0 else {"kind": ("and", "or")[n % 2], "of": [tree(n - 1), {"kind": "abs_before", "at": str(n)}, {"kind": "not", "of": [None]}]}

    def text(n):
        return {"unconditional": True} if n == 0 else {("and", "or")[n % 2]: [text(n - 1), {"abs_before": str(n)}, {"not": None}]}

    roots = spark.createDataFrame([("x", json.dumps(tree(9)))], "key string, j string").select("key", F.parse_json("j").alias("v"))
    assert json.loads(trees.whole_texts(roots, trees.PREDICATES, DataFrame.persist).first()["text"]) == text(9)


def test_deep_values_are_taken_apart_inside_their_row(spark):
    """No shuffle, no job and no file of its own, so the work grows with the rows."""
    jsons = [json.dumps(nested(3)), json.dumps(nested(9)), json.dumps(nested(40, "map")), json.dumps(buried(9)), None]
    rows = spark.createDataFrame([(i, j) for i, j in enumerate(jsons)], "id int, j string").select("id", F.array(F.parse_json("j")).alias("values"))
    rows = rows.withColumn("shown", F.transform("values", lambda v: S.display(v)))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("deep", "deep")
    try:
        whole = trees.complete(rows, F.col("values"), "shown", trees.VALUES)
        assert not tracker.getJobIdsForGroup("deep")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["shown"][0] for r in whole.collect()} == {0: shown(nested(3)), 1: shown(nested(9)), 2: shown(nested(40, "map")), 3: None, 4: None}
