"""Aggregates in steps, over batches in any order, against the aggregates of all rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyspring.operators import deltas, incremental, rollups, writes
from tallyspring.operators.builders import typed


def token_events(spark, ids):
    r, rows = random.Random(9), []
    for i in range(400):
        kind = r.choice(["mint", "burn", "clawback", "transfer", "transfer"])
        code = r.choice(["A", "B", None])
        rows.append((i // 4, i % 4, kind, None if kind == "mint" else f"h{r.randint(0, 9)}", None if kind in ("burn", "clawback") else f"h{r.randint(0, 9)}", code, code and "I", r.randint(0, 99), datetime.datetime(2024, 1, 1 + i // 80, r.randint(0, 2))))
    df = spark.createDataFrame([rows[i] for i in ids], "ledger_sequence long, event_ordinal int, event_type_name string, from_address string, to_address string, asset_code string, asset_issuer string, amount int, created_at timestamp")
    return typed(df, "token_events")


def transactions(spark, ids):
    rows = [(f"t{i}", i, None if i % 11 == 0 else 100 + i, [True, False, None][i % 3], datetime.datetime(2024, 1, 1 + i // 30)) for i in ids]
    return typed(spark.createDataFrame(rows, "hash string, ledger_sequence long, fee_charged long, is_soroban boolean, created_at timestamp"), "transactions")


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def candles(events):
    rows = events.filter("asset_code IS NOT NULL AND event_type_name = 'transfer'").withColumn("tie", F.struct("ledger_sequence", "event_ordinal"))
    told = rollups.ohlc(rows, pair=["asset_code", "asset_issuer"], time="created_at", price="amount", tie="tie")
    return told.withColumnRenamed("n_trades", "n")


def whole(spark, folder):
    events, tx = (deltas.read(spark, folder, t) for t in ("token_events", "transactions"))
    return {
        "agg_balances": rollups.balances(events), "agg_supply": rollups.asset_supply(events), "agg_transfer_candles": candles(events),
        "agg_days": rollups.daily_stats(tx, time="created_at", fee="fee_charged", flag=F.coalesce("is_soroban", F.lit(False))),
    }


def check(spark, folder):
    for name, expected in whole(spark, folder).items():
        found = incremental.result(spark, folder, name)
        decimals = [F.col(f.name).cast("decimal(38,0)").alias(f.name) if f.dataType.simpleString().startswith("decimal(38") or f.name in ("balance", "supply") else F.col(f.name) for f in expected.select(found.columns).schema.fields]
        assert rows_of(found) == rows_of(expected.select(found.columns).select(*decimals)), name


@pytest.mark.parametrize("seed", [0])
def test_steps_in_any_order_equal_the_whole(spark, tmp_path, seed):
    folder, r = str(tmp_path), random.Random(seed)
    ids, tx = list(range(400)), list(range(100))
    r.shuffle(ids), r.shuffle(tx)
    for k in range(3):
        writes.append(token_events(spark, ids[k::3]), folder, "token_events")
        if k != 1:
            writes.append(transactions(spark, tx[k // 2 :: 2]), folder, "transactions")
        for name in whole(spark, folder):
            at = incremental.step(spark, folder, name)
            assert incremental.step(spark, folder, name) == at  # nothing new
        if k == 1:
            for name in whole(spark, folder):
                incremental.compact(spark, folder, name, grace=0)
            deltas.compact(spark, folder, "token_events")  # replaced versions stay for a while
        check(spark, folder)
    writes.append(token_events(spark, ids), folder, "token_events")  # a replay adds nothing
    for name in whole(spark, folder):
        incremental.step(spark, folder, name)
    check(spark, folder)
    deltas.compact(spark, folder, "token_events", grace=0)
    check(spark, folder)


def test_a_state_that_lost_its_versions_is_worked_out_anew(spark, tmp_path):
    folder = str(tmp_path)
    writes.append(token_events(spark, range(100)), folder, "token_events")
    incremental.step(spark, folder, "agg_balances")
    for k in range(100, 400, 100):
        writes.append(token_events(spark, range(k, k + 100)), folder, "token_events")
    deltas.compact(spark, folder, "token_events", grace=0)  # nobody can read the versions any more
    incremental.step(spark, folder, "agg_balances")
    assert rows_of(incremental.result(spark, folder, "agg_balances")) == rows_of(whole(spark, folder)["agg_balances"].withColumn("balance", F.col("balance").cast("decimal(38,0)")))


def test_a_step_that_died_is_done_again(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    writes.append(token_events(spark, range(50)), folder, "token_events")

    def crash(*_, **__):
        raise OSError

    with monkeypatch.context() as m:
        m.setattr(deltas, "commit", crash)
        with pytest.raises(OSError):
            incremental.step(spark, folder, "agg_supply")
    incremental.step(spark, folder, "agg_supply")
    assert rows_of(incremental.result(spark, folder, "agg_supply")) == rows_of(whole(spark, folder)["agg_supply"].withColumn("supply", F.col("supply").cast("decimal(38,0)")))
    with pytest.raises(ValueError, match="takes rows back"):
        deltas.commit(token_events(spark, [60]), folder, "token_events", deletes=token_events(spark, [1]).select("ledger_sequence", "event_ordinal", "created_at"))
        incremental.step(spark, folder, "agg_supply")
