"""One writer fed by many requests, tables that take appends during compaction, landing rows in any order, and bounded reads."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tallyspring.operators import deltas, gaps, writes
from tallyspring.schemas import KEYS
from tallyspring.sources import landing
from tallyspring.streaming import ingest
from tallyspring.streaming.lease import EXPIRES, Lease, Lost

from .test_streaming import bare, land, lake, ledgers, sizes, there, transactions  # noqa: F401


def contents(spark, lake):
    """All rows of the tables with keys, in order."""
    return {t: sorted(map(str, lake.table(spark, t).drop("chunk").collect())) for t in KEYS}


def keys_are_unique(spark, lake):
    return all(lake.table(spark, t).groupBy(*keys).count().filter("count > 1").isEmpty() for t, keys in KEYS.items())


def test_two_backfills_at_once(spark, lake):
    failed = []

    def run():
        try:
            ingest.backfill(spark, lake, 3, 19)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=run) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and there(spark, lake) == list(range(3, 20)) and keys_are_unique(spark, lake)
    assert lake.table(spark, "transactions").count() == sum(n > 0 or i % 10 != 7 for i in range(3, 20) for n in range(i % 3))
    assert not ingest.pending(spark, lake)


def test_repair_and_backfill_beside_a_tail(spark, bare, tmp_path):
    land(spark, bare, range(3, 12))
    query = ingest.tail(spark, bare, str(tmp_path / "checkpoint"), every="100 milliseconds")  # from 11 on
    with pytest.raises(Lost):
        ingest.tail(spark, bare, str(tmp_path / "other"), wait=0)
    assert ingest.backfill(spark, bare, 3, 5)["ledgers"] == 3
    assert ingest.repair(spark, bare)["ledgers"] == 5
    assert query.isActive
    query.stop()
    assert there(spark, bare) == list(range(3, 12)) and keys_are_unique(spark, bare)
    assert ingest.repair(spark, bare) == dict.fromkeys(ingest.COUNTS, 0)  # nothing is missing


def test_a_dead_writers_lease_ends(spark, bare):
    dead = Lease(spark, bare.tables)
    assert dead.take()
    assert not Lease(spark, bare.tables).take()
    dead.ended.set()  # its heart stops
    dead.files.fs.setTimes(dead.files.path(dead.name), int((time.time() - EXPIRES - 5) * 1000), -1)
    heir = Lease(spark, bare.tables)
    assert heir.take()
    with pytest.raises(Lost):
        dead.check()
    dead.release()  # not its own any more
    heir.check()
    heir.release()
    assert Lease(spark, bare.tables).take()


#: Ledgers by the order in which they land, and what lands at each of four times.
STEPS = {
    "ledgers first": (range(4, 9), ["l", "", "t", ""]),
    "transactions first": (range(10, 15), ["t", "", "l", ""]),
    "together": (range(20, 25), ["", "lt", "", ""]),
    "very late": (range(30, 35), ["l", "", "", "t"]),
    "bit by bit": (range(40, 45), ["l", "1", "", "2"]),
}


def test_landing_order_changes_nothing(spark, bare, tmp_path):
    land(spark, bare, [3])
    # the first run starts at ledger 3, and one stream goes on through the other times
    query = ingest.tail(spark, bare, str(tmp_path / "checkpoint"), every="50 milliseconds")
    query.processAllAvailable()
    part = {"t": "true", "1": "application_order = 1", "2": "application_order > 1"}
    for step in range(4):
        for ids, what in STEPS.values():
            if "l" in what[step]:
                landing.land(ledgers(spark, ids).coalesce(1), bare.ledgers, "sequence")
            for kind in set(what[step]) & set(part):
                landing.land(transactions(spark, ids).filter(part[kind]).coalesce(1), bare.transactions, "ledger")
        query.processAllAvailable()
    query.stop()
    assert keys_are_unique(spark, bare)
    everything = sorted(i for ids, _ in STEPS.values() for i in ids)
    assert there(spark, bare) == [3, *everything]
    assert {r["sequence"]: r["transaction_count"] for r in bare.table(spark, "ledgers").collect()} == {i: i % 3 for i in [3, *everything]}
    # the same tables as when all lie there at once
    again = ingest.Lake(bare.ledgers, bare.transactions, str(tmp_path / "again"), bare.domain)
    ingest.create_tables(spark, again)
    ingest.backfill(spark, again, 3, 50)
    assert contents(spark, bare) == contents(spark, again)


def test_rows_that_differ_for_one_ledger(spark, bare):
    both = ledgers(spark, [4]).unionByName(ledgers(spark, [4]).withColumn("hash", F.lit("a")))
    landing.land(both.repartition(2), bare.ledgers, "sequence")
    for _ in range(2):
        ingest.backfill(spark, bare, 4, 4)
        assert bare.table(spark, "ledgers").first()["hash"] == "a"
        assert [(r["source"], r["reason"], r["ledger"]) for r in bare.table(spark, "quarantine").collect()] == [("landing", "repeated", 4)]


# Tables


def some(spark, ids):
    """Operations by number."""
    from tallyspring.operators.builders import typed

    df = spark.createDataFrame([(f"t{i}", i, i % 3) for i in ids], "transaction_hash string, application_order int, type int")
    return typed(df.withColumn("created_at", F.timestamp_seconds(F.lit(1700000000) + F.col("application_order") * 40_000)), "operations")


def numbers(spark, folder):
    return sorted(r[0] for r in deltas.read(spark, folder, "operations").select("application_order").collect())


def test_appends_during_compaction_stay(spark, tmp_path):
    folder = str(tmp_path)
    writes.append(some(spark, range(20)), folder, "operations")
    deltas.compact(spark, folder, "operations", grace=0, between=lambda: writes.append(some(spark, range(10, 40)), folder, "operations"))
    assert numbers(spark, folder) == list(range(40))
    assert deltas.compact(spark, folder, "operations", "2023-11-14", grace=0) == 0  # the first week has nothing new
    writes.append(some(spark, range(45)), folder, "operations")
    assert numbers(spark, folder) == list(range(45))
    assert deltas.compact(spark, folder, "operations", grace=0) > 0 == deltas.compact(spark, folder, "operations", grace=0)
    assert numbers(spark, folder) == list(range(45))


class Crash(Exception):
    pass


def crash():
    raise Crash


def test_a_crash_of_compaction_loses_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    for k in range(3):
        writes.append(some(spark, range(10 * k, 10 * k + 15)), folder, "operations")
    with pytest.raises(Crash):  # rows are written, but don't count
        deltas.compact(spark, folder, "operations", between=crash)
    assert numbers(spark, folder) == list(range(35))
    with monkeypatch.context() as m:  # the base counts, nothing is removed yet
        m.setattr(deltas, "vacuum", lambda *_, **__: crash())
        with pytest.raises(Crash):
            deltas.compact(spark, folder, "operations")
    assert numbers(spark, folder) == list(range(35))
    remove = deltas.Files.delete
    for left in range(4):  # while old files go, one more each time
        told = [left]

        def few(self, name, told=told):
            if not told[0]:
                crash()
            told[0] -= 1
            remove(self, name)

        with monkeypatch.context() as m:
            m.setattr(deltas.Files, "delete", few)
            with pytest.raises(Crash):
                deltas.vacuum(spark, folder, "operations", grace=0)
        assert numbers(spark, folder) == list(range(35))
    writes.append(some(spark, range(33, 40)), folder, "operations")
    deltas.compact(spark, folder, "operations", grace=0)
    assert numbers(spark, folder) == list(range(40))
    root = f"{folder}/operations"
    assert not deltas.numbered(deltas.Files(spark, root).names(root), "version")
    some(spark, [99]).write.parquet(f"{root}/version=9999/kind=row/chunk=2023-11-13")
    deltas.Files(spark, root).delete(f"{root}/version=9999/_SUCCESS")  # a commit that died before its success mark
    assert numbers(spark, folder) == list(range(40))
    writes.append(some(spark, [40]), folder, "operations")
    assert numbers(spark, folder) == list(range(41))


def test_a_crash_between_tables_is_mended_by_the_replay(spark, lake, monkeypatch):  # noqa: F811
    commit, left = deltas.commit, [4]

    def few(*args, **more):
        left[0] -= 1
        return crash() if left[0] < 0 else commit(*args, **more)

    with monkeypatch.context() as m:
        m.setattr(deltas, "commit", few)
        with pytest.raises(Crash):
            ingest.backfill(spark, lake, 3, 20)
    assert len(ingest.pending(spark, lake)) == 1
    (request,) = ingest.pending(spark, lake)
    ingest.served(spark, lake, request)
    assert not ingest.pending(spark, lake) and there(spark, lake) == list(range(3, 21)) and keys_are_unique(spark, lake)


def test_corrections_take_back_rows(spark, tmp_path):
    folder = str(tmp_path)
    row = "sequence bigint, closed_at timestamp, transaction_count int"
    rows = lambda *r: writes_rows(spark, r, row)
    assert writes.upsert(rows((1, 0), (2, 0)), folder, "ledgers", ["transaction_count"]) == 2
    writes.upsert(rows((1, 5), (3, 1)), folder, "ledgers", ["transaction_count"])
    told = lambda: sorted((r["sequence"], r["transaction_count"]) for r in deltas.read(spark, folder, "ledgers").collect())
    assert told() == [(1, 5), (2, 0), (3, 1)]
    deltas.compact(spark, folder, "ledgers", grace=0)
    assert told() == [(1, 5), (2, 0), (3, 1)]
    writes.upsert(rows((1, 6)), folder, "ledgers", ["transaction_count"])
    writes.upsert(rows((1, 7)), folder, "ledgers", ["transaction_count"])
    assert told() == [(1, 7), (2, 0), (3, 1)]
    deltas.reset(spark, folder, "ledgers")
    assert told() == []
    writes.upsert(rows((1, 8)), folder, "ledgers", ["transaction_count"])
    assert told() == [(1, 8)]


def writes_rows(spark, rows, _):
    from tallyspring.operators.builders import typed

    df = spark.createDataFrame(list(rows), "sequence bigint, transaction_count int").withColumn("closed_at", F.timestamp_seconds(F.lit(1700000000) + F.col("sequence")))
    return typed(df, "ledgers")


def test_files_stay_few(spark, bare):  # noqa: F811
    for k in range(7):
        ingest.put_state(bare, ingest.CURSOR, spark.range(1).select(F.lit(k)))
        deltas.commit(gaps.presence(spark.range(10 * k, 10 * k + 10), "id"), bare.tables, "ledger_presence")
        ingest.finish(spark, bare, k, k, dict.fromkeys(ingest.COUNTS, 1), None)
        ingest.merge_often(spark, bare, after=2)
        for table in ingest.STATE:
            at = deltas.layout(spark, bare.tables, table)
            assert sum(map(len, at.rows.values())) <= 2, table
    assert landing.cursor(bare.table(spark, "ingestion_state")).first()[0] == 6
    assert ingest.totals(spark, bare).first()["ledgers"] == 7
    assert ingest.absent(spark, bare).count() == 0 and bare.table(spark, "ledger_presence").groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits"))).first()[1] == 70


def test_state_folds_keep_what_is_read(spark, tmp_path):
    folder, at = str(tmp_path), 0
    for key, value in (("c", "5"), ("c", "9"), ("s", "7"), ("c", "6"), ("s", "3"), ("c", None), ("c", "2"), ("c", "4"), ("c", "1")):
        at += 1
        deltas.commit(spark.createDataFrame([(key, value, at)], "key string, value string, n int").select("key", "value", F.timestamp_seconds("n").alias("updated_at")), folder, "ingestion_state")
    deltas.compact(spark, folder, "ingestion_state", grace=0)
    state = deltas.read(spark, folder, "ingestion_state")
    assert landing.cursor(state, "c").first()[0] == 4
    assert sorted((r["key"], r["value"] or "") for r in state.collect()) == [("c", ""), ("c", "1"), ("c", "4"), ("s", "3"), ("s", "7")]


# Gaps and parts


@pytest.mark.parametrize("ids", [[5], [1, 2, 3], range(32_760, 32_780), [3, 32_767, 32_768, 65_535, 65_536, 200_000], range(0, 32_768), [10, 400_000]])
def test_absent_ranges_are_those_of_the_ids(spark, ids):
    ids = list(ids)
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    bitmaps = gaps.presence(df.filter("id % 2 = 0"), "id").union(gaps.presence(df.filter("id % 2 = 1"), "id"))
    for low, high in ((min(ids), max(ids)), (0, max(ids) + 40_000)):
        expected, at = [], low
        for i in [*ids, high + 1]:
            if i > at:
                expected.append((at, i - 1))
            at = max(at, i + 1)
        assert sorted(map(tuple, gaps.absent_ranges(bitmaps, low, high).collect())) == expected


def test_first_ids_of_ranges(spark):
    ranges = spark.createDataFrame([(50, 59), (1, 3), (10, 19)], "range_start bigint, range_end bigint")
    for most, expected in ((1, [(1, 1)]), (3, [(1, 3)]), (5, [(1, 3), (10, 11)]), (100, [(1, 3), (10, 19), (50, 59)])):
        assert sorted(map(tuple, gaps.first_ids(ranges, most).collect())) == expected


def test_rows_in_long_and_short_ranges(spark):
    rows = spark.range(0, 5000).withColumnRenamed("id", "sequence")
    spans = [(5, 5), (90, 310), (400, 499), (450, 460), (1000, 2**40)]
    found = gaps.rows_in_ranges(rows, spark.createDataFrame(spans[:-1] + [(1000, 10**7)], "range_start bigint, range_end bigint"), bucket=100)
    assert sorted(r[0] for r in found.collect()) == [i for i in range(5000) if any(a <= i <= b for a, b in spans)]


def test_repair_of_a_huge_gap(spark, bare):
    far = 100_000_001
    land(spark, bare, [4, 5, 7, far])
    deltas.commit(gaps.presence(spark.createDataFrame([(4,), (far,)], "id bigint"), "id"), bare.tables, "ledger_presence")
    ranges = ingest.absent(spark, bare, None)
    assert ranges.count() <= 3 and ranges.agg(F.sum(F.col("range_end") - F.col("range_start") + 1)).first()[0] == far - 5
    assert list(ingest.absent(spark, bare, 500).first()) == [5, 504]
    ingest.repair(spark, bare, None)
    assert there(spark, bare) == [5, 7]
    ingest.backfill(spark, bare, 0, 2**61)  # an open end
    assert there(spark, bare) == [4, 5, 7, far]


def test_a_batch_reads_its_parts_alone(spark, bare, monkeypatch):
    per = landing.LEDGERS_PER_PARTITION
    for k in range(6):
        land(spark, bare, [k * per + 4])
    read = []
    raw = landing.raw

    def seen(*args):
        df = raw(*args)
        read.append(len(df.inputFiles()))
        return df

    monkeypatch.setattr(landing, "raw", seen)
    ingest.backfill(spark, bare, per, per + 100)
    assert read == [1, 1]  # files of ledgers and of transactions, of six each
    plan = raw(spark, bare.ledgers, ingest.LEDGERS_RAW, [1, 99])
    assert "PartitionFilters: [part" in plan._jdf.queryExecution().toString() and plan.count() == 1
    assert raw(spark, bare.ledgers, ingest.LEDGERS_RAW, [99]).count() == 0


@pytest.mark.parametrize("least", [0, 7, 9, 10, 95, 199, 960])
def test_patterns_of_parts(spark, tmp_path, least):
    path = str(tmp_path)
    numbers = [0, 1, 7, 8, 9, 10, 11, 94, 95, 96, 99, 100, 198, 199, 200, 959, 960, 961, 999, 1000, 12345]
    files = deltas.Files(spark, path)
    for n in numbers:
        files.fs.mkdirs(files.path(f"{path}/part={n}"))
    found = files.fs.globStatus(files.path(landing.parts_from(path, least)))
    assert sorted(int(f.getPath().getName().split("=")[1]) for f in found) == [n for n in numbers if n >= least]
