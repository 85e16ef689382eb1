"""Contracts and their code in hash buckets: merges that write what they change, replays, crashes and counts."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyspring.operators import deltas, writes
from tallyspring.schemas import table_schema

AT = datetime.datetime(2024, 1, 1)


def arrivals(spark, rows):
    """(contract, ledger, hash, name)"""
    full = [(c, 0, h, False, False, n, None, None, None, None, ledger, AT, AT) for c, ledger, h, n in rows]
    return spark.createDataFrame(full, table_schema("contracts"))


def codes_of(used):
    return used.select("wasm_hash").distinct().select("wasm_hash", F.lit(b"code").alias("wasm_bytecode"), F.lit(4).alias("wasm_size"), F.lit("spec").alias("contract_spec"), F.lit("{}").alias("spec_parsed"))


def told(spark, folder):
    contracts = {r["contract_id"]: (r["wasm_hash"], r["name"], r["created_ledger"]) for r in deltas.read(spark, folder, "contracts").collect()}
    return contracts, {r["wasm_hash"]: r["contract_count"] for r in deltas.read(spark, folder, "contract_code").collect()}


BATCHES = [
    [("c1", 5, "aa", "N"), ("c2", 5, "aa", None), ("c3", 6, "bb", None), ("c4", 6, None, None)],
    [("c1", 9, "bb", None), ("c5", 9, "bb", "X")],
    [("c2", 10, None, "M"), ("c1", 11, "cc", None), ("c1", 12, "aa", None)],
]
EXPECTED = (
    {"c1": ("aa", "N", 5), "c2": (None, "M", 5), "c3": ("bb", None, 6), "c4": (None, None, 6), "c5": ("bb", "X", 9)},
    {"aa": 1, "bb": 2},
)


def test_batches_merge_as_the_policies_say(spark, tmp_path):
    folder = str(tmp_path)
    for rows in BATCHES:
        for _ in range(2):  # a replay changes nothing
            writes.write_contracts(arrivals(spark, rows), codes_of, folder)
    assert told(spark, folder) == EXPECTED
    for table in ("contracts", "contract_code", "code_users"):
        deltas.compact(spark, folder, table, grace=0)
        assert deltas.read(spark, folder, table).groupBy(*deltas.keys_of(table)).count().filter("count > 1").isEmpty()
    assert told(spark, folder) == EXPECTED
    # the same as the merges of whole tables
    old = spark.createDataFrame([], table_schema("contracts"))
    for rows in BATCHES:
        old = writes.upsert_contracts(old, arrivals(spark, rows))
    assert {r["contract_id"]: (r["wasm_hash"], r["name"], r["created_ledger"]) for r in old.collect()} == EXPECTED[0]


@pytest.mark.parametrize("at", range(3))
def test_a_crash_between_the_tables(spark, tmp_path, monkeypatch, at):
    folder, commit, left = str(tmp_path), deltas.commit, [at]

    def few(*args, **more):
        left[0] -= 1
        if left[0] < 0:
            raise OSError
        return commit(*args, **more)

    for rows in BATCHES:
        left[0] = at
        with monkeypatch.context() as m:
            m.setattr(deltas, "commit", few)
            with pytest.raises(OSError):
                writes.write_contracts(arrivals(spark, rows), codes_of, folder)
        writes.write_contracts(arrivals(spark, rows), codes_of, folder)
    assert told(spark, folder) == EXPECTED


def test_what_is_written_follows_the_batch(spark, tmp_path):
    folder = str(tmp_path)
    many = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("c"), F.lit(1).alias("l"), F.format_string("%02d", F.col("id") % 50).alias("h"), F.lit("some name").alias("n"))
    writes.write_contracts(arrivals(spark, many.collect()), codes_of, folder)
    writes.write_contracts(arrivals(spark, [("k7", 2, "07", "other")]), codes_of, folder)
    root = f"{folder}/contracts"
    files = deltas.Files(spark, root)
    sizes = [sum(s.getLength() for s in (files.fs.getContentSummary(files.path(f"{root}/version={v}")),)) for v in deltas.numbered(files.names(root), "version")]
    assert sizes[-1] < sizes[0] / 10
    layout = deltas.layout(spark, folder, "contracts")
    assert sum(layout.newest in vs for vs in layout.rows.values()) == 1  # one bucket of 64
    assert told(spark, folder)[1]["07"] == 400
