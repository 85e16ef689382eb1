"""Reads of landing rows, and small operators that no registered query covers."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyspring.operators import rollups, writes
from tallyspring.sources import landing
from tallyspring.streaming import publish
from tallyspring.streaming.ingest import deduplicated

DOCUMENT = (
    "hash binary, close_time bigint, header struct<ledger_seq:bigint,ledger_version:int>, header_xdr string, token_events array<string>, "
    "transactions array<struct<successful:boolean,fee_bump:boolean,envelope_xdr:string>>"
)


def test_rows_of_ledger_documents(spark):
    docs = spark.createDataFrame([(b"\xab\xcd", 1700000000, (7, 21), "x", [], [(True, False, "a"), (False, True, "b")]), (b"\x01", 5, (8, 21), "y", [], [])], DOCUMENT)
    ledgers = landing.ledger_rows(docs).orderBy("sequence").collect()
    assert [(r["sequence"], r["hash"], r["ledger_close_time"]) for r in ledgers] == [(7, "abcd", "1700000000"), (8, "01", "5")]
    rows = landing.transaction_rows(docs).orderBy("application_order").collect()
    assert [(r["ledger"], r["application_order"], r["status"], r["fee_bump"], r["envelope_xdr"]) for r in rows] == [(7, 1, "SUCCESS", False, "a"), (7, 2, "FAILED", True, "b")]


def test_lake_ranges_prune_partitions(spark, tmp_path):
    ids = spark.range(1, 200_000).withColumnRenamed("id", "sequence").withColumn("part", landing.lake_partition(F.col("sequence")))
    ids.write.partitionBy("part").parquet(str(tmp_path / "lake"))
    found = landing.lake_range(spark, str(tmp_path / "lake"), 1, 70_000)
    assert found.agg(F.min("sequence"), F.max("sequence"), F.count("*")).first()[:] == (3, 70_000, 69_998)
    assert found.select(F.input_file_name().alias("f")).distinct().filter("f like '%part=3%'").count() == 0
    with pytest.raises(ValueError, match="before its start"):
        landing.ledger_range(found, 5, 4)
    assert landing.latest(found).first()[0] == 70_000


def test_listings_and_intervals(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, at + datetime.timedelta(seconds=5 * i)) for i in range(10)], "sequence bigint, closed_at timestamp")
    assert [r["sequence"] for r in rollups.newest(rows, "closed_at").collect()] == [9, 8, 7, 6, 5]
    gaps = rollups.close_gaps(rows, bucket=4)
    assert [r["gap"] for r in gaps.collect()] == [5] * 9


def test_new_columns_are_null_in_old_rows(spark):
    old, new = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")
    assert sorted(map(tuple, writes.evolve(old, new).collect())) == [(1, None), (2, "x")]


def test_messages(spark):
    ledger = spark.createDataFrame([(12345, "testhash", datetime.datetime(2024, 1, 1), 5, 10, 21)], "sequence bigint, hash string, closed_at timestamp, transaction_count int, operation_count int, protocol_version int")
    value = publish.ledger_messages(ledger).first()["value"]
    assert value == '{"sequence":12345,"hash":"testhash","closed_at":"2024-01-01T00:00:00Z","transaction_count":5,"operation_count":10,"protocol_version":21}'


def test_repeats_in_a_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, at), (1, at), (2, at)], "id bigint, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = deduplicated(spark.readStream.schema("id bigint, ts timestamp").parquet(str(tmp_path / "in")), ["id"], "ts")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
