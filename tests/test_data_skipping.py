"""Look-ups by columns other than a table's segment read few row groups of compacted files, and give the rows of a full scan."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspring.operators import deltas, rollups
from tallyspring.schemas import BLOOMS, SEGMENTS, table_schema

N = 24_000


def rows_of(spark, table, n=N, distinct=9_973):
    """Rows of a week or month whose looked-up columns are unrelated to one another; one segment has most rows."""
    schema = table_schema(table)
    unlike = lambda c: F.sha2(F.concat_ws("-", F.lit(c), F.col("id") % distinct), 256)
    columns = []
    for f in schema.fields:
        kind = f.dataType.simpleString()
        if kind == "timestamp":
            value = F.timestamp_seconds(F.lit(1_709_510_400) + F.col("id") % 400_000)
        elif f.name == SEGMENTS[table]:
            segment = F.when(F.col("id") % 10 < 7, F.lit(1)).otherwise(F.col("id") % 23)
            value = segment.cast(kind) if kind == "smallint" else unlike(f.name)
        elif f.name in BLOOMS[table]:
            value = F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)) if kind == "bigint" else unlike(f.name)
        else:
            value = F.lit(None)
        columns.append(value.cast(f.dataType).alias(f.name))
    return spark.range(0, n, numPartitions=4).select(*columns, F.rand(3).alias("_any")).orderBy("_any").drop("_any")


def scanned(df):
    """Rows that the scans of a DataFrame give to the filter above them, in the row groups that they couldn't skip."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.mark.parametrize("table", ["transactions", "operations", "token_events", "contract_events"])
def test_paths_skip_row_groups(spark, tmp_path, monkeypatch, table):
    folders = {True: str(tmp_path / "with"), False: str(tmp_path / "without")}
    for blooms, folder in folders.items():
        deltas.commit(rows_of(spark, table), folder, table)
        with monkeypatch.context() as m:
            if not blooms:
                m.setitem(BLOOMS, table, [])
            assert deltas.compact(spark, folder, table, grace=0, row_group=128 << 10) > 0
    whole = rows_of(spark, table).persist()
    paths = [c for c in BLOOMS[table] if c in rollups.ACCESS_PATHS[table] and c != SEGMENTS[table]]
    assert paths
    for column in paths:
        value = whole.agg(F.min_by(column, F.xxhash64(column))).first()[0]
        tables = {b: deltas.read(spark, folder, table).filter(F.col(column) == value) for b, folder in folders.items()}
        reads = {b: scanned(df) for b, df in tables.items()}
        found = rollups.newest_where(deltas.read(spark, folders[True], table), table, {column: value}, n=N)
        expected = whole.filter(F.col(column) == value)
        assert found.count() == expected.count() > 0 and found.drop("chunk").exceptAll(expected).isEmpty()
        assert 0 < reads[True] < N / 4 and reads[True] <= reads[False], (column, reads)
    assert scanned(deltas.read(spark, folders[True], table).filter(F.col(paths[0]) == "nobody")) < N / 4
    whole.unpersist()


def test_filters_serve_where_dictionaries_are_too_large(spark, tmp_path, monkeypatch):
    n, table = 160_000, "operations"  # a dictionary ends at a megabyte, 16,000 hashes
    rows = rows_of(spark, table, n, n).persist()
    value = rows.agg(F.min_by("transaction_hash", F.xxhash64("transaction_hash"))).first()[0]  # between the ends of any row group
    reads = {}
    monkeypatch.setattr(deltas, "vacuum", lambda *_, **__: None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name, blooms in (("with", BLOOMS[table]), ("without", [])):
            monkeypatch.setitem(BLOOMS, table, blooms)
            deltas.commit(rows, str(tmp_path / name), table)
            deltas.compact(spark, str(tmp_path / name), table)
            reads[name] = scanned(deltas.read(spark, str(tmp_path / name), table).filter(F.col("transaction_hash") == value))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        rows.unpersist()
    assert 0 < reads["with"] <= n / 2 < reads["without"] == n


def test_a_segment_with_most_rows_is_split(spark, tmp_path):
    folder = str(tmp_path)
    deltas.commit(rows_of(spark, "operations"), folder, "operations")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        deltas.compact(spark, folder, "operations", grace=0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = deltas.read(spark, folder, "operations").withColumn("file", F.input_file_name())
    shares = [r["count"] / N for r in found.groupBy("file").count().collect()]
    assert len(shares) > 1 and max(shares) < 0.5
    assert found.filter("type = 1").select("file").distinct().count() > 1


def test_unknown_path(spark):
    with pytest.raises(ValueError, match="no access path"):
        rollups.newest_where(spark.createDataFrame([], "a int"), "operations", {"details": "x"})
