"""Ingest through files: replay, restart, gaps, quarantine, messages and compaction."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tallyspring.operators import deltas, gaps, writes
from tallyspring.schemas import LEDGERS_RAW, TRANSACTIONS_RAW, table_schema
from tallyspring.sources import landing
from tallyspring.streaming import ingest, lease

HEADER = (1, b"\x01", 10**12, 100000, 100, 5000000, 1000, 21)


def ledgers(spark, ids):
    return spark.createDataFrame([(i, f"h{i}", str(1700000000 + 5 * i) if i % 50 else "never", (i, *HEADER[1:]), None, []) for i in ids], LEDGERS_RAW)


def transactions(spark, ids):
    rows = []
    for i in ids:
        for n in range(i % 3):
            payload = None if i % 10 == 7 and n == 0 else f"{i}-{n}".encode()
            rows.append((i, n + 1, "SUCCESS" if n else None, False, 1700000000 + 5 * i, payload, ("G1", None, None), 1, 100, ("tx_success" if n else "tx_failed", 100), (1, "memo", None, None), [(1, "OperationTypePayment", None, None)] * n, (3, None, None, None), "e", "r", "m"))
    return spark.createDataFrame(rows, TRANSACTIONS_RAW)


@pytest.fixture
def lake(spark, tmp_path):
    made = ingest.Lake(str(tmp_path / "ledgers"), str(tmp_path / "transactions"), str(tmp_path / "tables"), b"network")
    ingest.create_tables(spark, made)
    for part in (range(3, 20), range(20, 40)):
        landing.land(ledgers(spark, part), made.ledgers, "sequence")
        landing.land(transactions(spark, part), made.transactions, "ledger")
    return made


def sizes(spark, lake):
    return {t: lake.table(spark, t).count() for t in ("ledgers", "transactions", "operations", "token_events", "contract_events")}


def test_backfill_replay_repair_and_cursor(spark, lake):
    sent = []
    ingest.backfill(spark, lake, 3, 25)
    first = sizes(spark, lake)
    assert first["ledgers"] == 23 and first["operations"] == sum(n for i in range(3, 26) for n in range(i % 3) if not (i % 10 == 7 and n == 0))
    ingest.backfill(spark, lake, 3, 25)
    assert sizes(spark, lake) == first
    ingest.process(spark, lake, ledgers(spark, range(30, 36)), sent.append)
    assert ingest.landing.cursor(lake.table(spark, "ingestion_state")).first()[0] == 35
    assert [m.first()["topic"] for m in sent if m.count()] == ["stream:ledgers", "stream:transactions"]
    assert [r[0] for r in gaps.missing(lake.table(spark, "ledgers"), "sequence", 3, 35).collect()] == list(range(26, 30))
    ingest.repair(spark, lake)
    # ledger 26 has two transactions, 28 one; 27 has none
    repaired = lake.table(spark, "transactions").filter("ledger_sequence BETWEEN 26 AND 29").collect()
    assert sorted(r["ledger_sequence"] for r in repaired) == [26, 26, 28, 29, 29]
    assert gaps.missing(lake.table(spark, "ledgers"), "sequence", 3, 35).count() == 0
    assert ingest.landing.cursor(lake.table(spark, "ingestion_state")).first()[0] == 35
    one = lake.table(spark, "ledgers").filter("sequence = 8").first()
    assert (one["transaction_count"], one["successful_tx_count"], one["failed_tx_count"], one["operation_count"]) == (2, 1, 1, 1)
    assert lake.table(spark, "quarantine").filter("source = 'transactions'").count() > 0


def test_tail_starts_at_the_tip_and_resumes(spark, lake, tmp_path):
    checkpoint = str(tmp_path / "checkpoint")
    ingest.tail(spark, lake, checkpoint, once=True).awaitTermination()
    assert [r["sequence"] for r in lake.table(spark, "ledgers").collect()] == [39]
    landing.land(ledgers(spark, range(40, 45)), lake.ledgers, "sequence")
    landing.land(transactions(spark, range(40, 45)), lake.transactions, "ledger")
    for _ in range(2):
        ingest.tail(spark, lake, checkpoint, once=True).awaitTermination()
        assert sorted(r["sequence"] for r in lake.table(spark, "ledgers").collect()) == list(range(39, 45))


def land(spark, lake, ids):
    landing.land(ledgers(spark, ids).coalesce(1), lake.ledgers, "sequence")
    landing.land(transactions(spark, ids).coalesce(1), lake.transactions, "ledger")


def there(spark, lake):
    return sorted(r["sequence"] for r in lake.table(spark, "ledgers").select("sequence").collect())


@pytest.fixture
def bare(spark, tmp_path):
    made = ingest.Lake(str(tmp_path / "ledgers"), str(tmp_path / "transactions"), str(tmp_path / "tables"), b"network")
    ingest.create_tables(spark, made)
    return made


def test_tail_takes_late_ledgers_after_restarts(spark, bare, tmp_path):
    for ids in (range(3, 6), range(20, 23), range(10, 13)):
        land(spark, bare, ids)
        ingest.tail(spark, bare, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert there(spark, bare) == [5, 10, 11, 12, 20, 21, 22]
    # the cursor didn't move back, and the start is the first run's for a new checkpoint too
    assert ingest.landing.cursor(bare.table(spark, "ingestion_state")).first()[0] == 22
    assert ingest.start_sequence(spark, bare) == 5
    ingest.tail(spark, bare, str(tmp_path / "other"), once=True).awaitTermination()
    assert there(spark, bare) == [5, 10, 11, 12, 20, 21, 22]


def test_tail_caps_its_batches_and_runs_at_intervals(spark, bare, tmp_path):
    land(spark, bare, [3])
    ingest.tail(spark, bare, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    for i in range(4, 8):
        land(spark, bare, [i])
    query = ingest.tail(spark, bare, str(tmp_path / "checkpoint"), files_per_batch=2, every="100 milliseconds")
    query.processAllAvailable()
    land(spark, bare, [8])
    query.processAllAvailable()
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    query.stop()
    assert there(spark, bare) == list(range(3, 9)) and len(read) in (3, 4)
    spans = [(r["low"], r["high"]) for r in bare.table(spark, "ingest_counters").orderBy("at").collect()]
    # the last ledger's transactions may land after the query has seen the ledger
    assert spans[:3] == [(3, 3), (4, 5), (6, 7)] and set(spans[3:]) == {(8, 8)}


def test_errors_in_sending_are_counted_only(spark, bare, tmp_path):
    land(spark, bare, range(6, 9))

    def broken(_):
        raise OSError("no route")

    counts = ingest.process(spark, bare, ledgers(spark, range(6, 9)), broken)
    assert there(spark, bare) == [6, 7, 8] and counts["publish_errors"] == 2
    assert ingest.landing.cursor(bare.table(spark, "ingestion_state")).first()[0] == 8


def test_counts_and_running_totals(spark, bare):
    land(spark, bare, range(6, 9))
    # ledger 7 has one transaction, which can't be built, 8 has two with one operation
    expected = {"ledgers": 3, "transactions": 2, "operations": 1, "token_events": 0, "contract_events": 0, "errors": 1, "publish_errors": 0}
    assert ingest.backfill(spark, bare, 6, 8) == expected == ingest.backfill(spark, bare, 6, 8)
    assert ingest.totals(spark, bare).first().asDict() == {k: 2 * v for k, v in expected.items()}
    assert bare.table(spark, "quarantine").count() == 1  # a replay doesn't add it again


def test_bad_times_never_stop_a_batch(spark, bare):
    rows = [(1, str(2**63 - 1)), (2, "2024-01"), (3, "12:30"), (4, "1700000000"), (5, None)]
    raw = spark.createDataFrame([(i, f"h{i}", at, (i, *HEADER[1:]), None, []) for i, at in rows], LEDGERS_RAW)
    late = transactions(spark, [4, 5]).withColumn("created_at", F.when(F.col("ledger") == 5, 2**62).otherwise(F.col("created_at")))
    landing.land(late, bare.transactions, "ledger")
    counts = ingest.process(spark, bare, raw)
    assert there(spark, bare) == [4] and counts["errors"] == 4 + 2 and counts["transactions"] == 1


def test_events_reach_their_tables(spark, bare):
    token = ("transfer", "GA", "GB", "12", ("issued", "USDC", "GI"), None, "tx", 0, datetime.datetime(2023, 11, 15), None)
    wide = ("transfer", "G" * 57, *token[2:])
    raw = spark.createDataFrame([(4, "h4", "1700000000", (4, *HEADER[1:]), None, [token, wide])], LEDGERS_RAW)
    event = (b"\x0a", 1, 0, [("x", None)], ("y", None))
    contract = [("created", "contract_data", "contract", b"\x0a", "instance")]
    body = [(24, "OperationTypeInvokeHostFunction", None, None)]
    row = (4, 1, "SUCCESS", False, 1700000000, b"p", ("G1", None, None), 1, 100, ("tx_success", 1), (0, None, None, None), body, (4, contract, None, [(None, [event])]), "e", "r", "m")
    landing.land(spark.createDataFrame([row], TRANSACTIONS_RAW), bare.transactions, "ledger")
    for _ in range(2):
        counts = ingest.process(spark, bare, raw)
        assert (counts["token_events"], counts["contract_events"], counts["errors"]) == (1, 1, 1)
        assert sizes(spark, bare) == {"ledgers": 1, "transactions": 1, "operations": 1, "token_events": 1, "contract_events": 1}
        assert bare.table(spark, "detected_contracts").count() == 1
    assert bare.table(spark, "contract_events").first()["contract_id"] == "0a"
    assert bare.table(spark, "transactions").first()["is_soroban"]


def test_repair_at_set_times(spark, bare, tmp_path):
    land(spark, bare, range(3, 12))
    ingest.backfill(spark, bare, 3, 5)
    ingest.backfill(spark, bare, 9, 11)
    query = ingest.repair_regularly(spark, bare, str(tmp_path / "clock"), every="1 second")
    end = datetime.datetime.now() + datetime.timedelta(seconds=90)
    while there(spark, bare) != list(range(3, 12)) and datetime.datetime.now() < end:
        query.awaitTermination(1)
    query.stop()
    assert there(spark, bare) == list(range(3, 12))


def test_deleting_the_cursor_alone(spark, bare):
    land(spark, bare, range(3, 5))
    ingest.backfill(spark, bare, 3, 4)
    writes.reset_cursor(spark, bare.tables)
    assert ingest.landing.cursor(bare.table(spark, "ingestion_state")).first()[0] == 0 and there(spark, bare) == [3, 4]
    ingest.backfill(spark, bare, 3, 3)
    assert ingest.landing.cursor(bare.table(spark, "ingestion_state")).first()[0] == 3


def test_compaction_keeps_rows(spark, lake):
    ingest.backfill(spark, lake, 3, 39)
    before = lake.table(spark, "operations").agg(F.sum(F.xxhash64(*(f.name for f in table_schema("operations").fields)).cast("decimal(38,0)"))).first()
    assert deltas.compact(spark, lake.tables, "operations", "2999-01-01") >= 1
    assert lake.table(spark, "operations").agg(F.sum(F.xxhash64(*(f.name for f in table_schema("operations").fields)).cast("decimal(38,0)"))).first() == before
    most = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", "1000000")
    assert "PartitionFilters: [isnotnull(chunk" in lake.table(spark, "operations").filter("chunk = '2023-11-13'")._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.maxPlanStringLength", most)


def test_bad_close_time_goes_to_quarantine(spark, lake):
    ingest.process(spark, lake, ledgers(spark, [50, 51]))
    assert [r["sequence"] for r in lake.table(spark, "ledgers").collect()] == [51]


def test_reset(spark, lake):
    ingest.backfill(spark, lake, 3, 5)
    deltas.reset(spark, lake.tables, "ledgers")
    assert lake.table(spark, "ledgers").count() == 0
    ingest.backfill(spark, lake, 4, 6)
    assert there(spark, lake) == [4, 5, 6]


def test_contract_side_stream(spark, lake, tmp_path):
    from tallyspring.schemas import CODES, INSTANCES, TOKEN_METADATA

    now = datetime.datetime(2024, 1, 1)
    for rows in ([("c1", 5, now), ("c1", 5, now)], [("c2", 6, now)]):
        deltas.commit(spark.createDataFrame(rows, "contract_id string, created_ledger bigint, created_at timestamp"), lake.tables, "detected_contracts")
    instances = spark.createDataFrame([("c1", "asset", None), ("c2", "wasm", b"\xaa")], INSTANCES)
    codes = spark.createDataFrame([("aa", b"code", "c3BlYw==", [("function_v0", "transfer", "", [("to", "address")], ["bool"]), ("struct", "S", None, None, None)])], CODES)
    metadata = spark.createDataFrame([("c1", "N", "S", 7)], TOKEN_METADATA)
    for checkpoint in ("side", "side", "again"):
        ingest.follow_contracts(spark, lake, instances, codes, metadata, str(tmp_path / checkpoint)).awaitTermination()
        rows = sorted(lake.table(spark, "contracts").collect(), key=lambda r: r["contract_id"])
        assert [(r["contract_id"], r["is_token"], r["name"], r["created_ledger"], r["wasm_hash"]) for r in rows] == [("c1", True, "N", 5, None), ("c2", False, None, 6, "aa")]
        code = lake.table(spark, "contract_code").collect()
        assert [(r["wasm_hash"], r["wasm_bytecode"], r["wasm_size"], r["contract_spec"], r["contract_count"]) for r in code] == [("aa", b"code", 4, "c3BlYw==", 1)]
        assert json.loads(code[0]["spec_parsed"]) == [{"kind": "function_v0", "name": "transfer", "doc": "", "inputs": [{"name": "to", "type": "address"}], "outputs": ["bool"]}, {"kind": "struct", "name": "S"}]
