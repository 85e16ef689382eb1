"""Counts that are observed as rows pass, and ticks of a tail."""

import datetime
import time

from pyspark.sql import functions as F

from tallyspring.streaming import ingest, ticks

from .test_streaming import bare, land, ledgers, there, transactions  # noqa: F401


def names(spark, lake):
    return sorted(ingest.deltas.Files(spark, lake.tables).names(ticks.folder_of(lake.tables)))


def told_by(spark, lake, n_rows, seconds=60):
    """The tick after so many rows; listeners hear of a batch some time after its end."""
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        tick = ticks.last_tick(spark, lake.tables).first()
        if tick and tick["n_rows"] >= n_rows:
            return tick
        time.sleep(0.2)
    raise AssertionError(f"no tick of {n_rows} rows: {tick}")


def test_a_tail_leaves_one_tick(spark, bare, tmp_path):  # noqa: F811
    never = ingest.health(spark, bare).first()
    assert never["at"] is None and not never["stale"]
    land(spark, bare, range(3, 6))
    query = ingest.tail(spark, bare, str(tmp_path / "checkpoint"), every="100 milliseconds")
    query.processAllAvailable()
    tick = told_by(spark, bare, 3)
    # from ledger 5 on: its landing row and its two transactions
    assert (tick["low"], tick["high"], tick["arrived"], tick["n_rows"]) == (5, 5, 3, 3)
    land(spark, bare, range(6, 9))
    query.processAllAvailable()
    # rows that arrive are counted once each, whether they came in one batch or two
    tick = told_by(spark, bare, 3 + 3 + sum(i % 3 for i in range(6, 9)))
    assert tick["high"] == 8 and tick["n_rows"] == 9
    assert there(spark, bare) == list(range(5, 9))
    health = ingest.health(spark, bare).first()
    assert health["high"] == 8 and not health["stale"]
    later = F.lit(datetime.datetime.now(datetime.UTC) + datetime.timedelta(minutes=3))
    assert ingest.health(spark, bare, later).first()["stale"]
    query.stop()
    time.sleep(1)
    assert len(names(spark, bare)) == 1


def test_errors_by_kind_stay_under_replays(spark, bare):  # noqa: F811
    land(spark, bare, [7, 17, 50])
    for _ in range(2):
        counts = ingest.backfill(spark, bare, 7, 50)
        assert counts["errors"] == 3  # a payload each of 7 and 17, the time of 50
        kinds = {(r["source"], r["reason"]): r["n_errors"] for r in ingest.errors_by_kind(spark, bare).collect()}
        assert sum(kinds.values()) == 3 and {s for s, _ in kinds} == {"ledgers", "transactions"}


def test_no_job_counts_the_rows_of_a_batch(spark, bare, monkeypatch):  # noqa: F811
    land(spark, bare, range(6, 9))

    def count(_):
        raise AssertionError("a job that counts")

    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "count", count)
        counts = ingest.process(spark, bare, ledgers(spark, range(6, 9)))
    assert (counts["ledgers"], counts["transactions"], counts["errors"]) == (3, 2, 1)
