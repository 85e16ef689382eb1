"""Searches of the index equal a scan of the labels, after changes, replays, compaction and crashes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspring.operators import deltas, label_index, rollups
from tallyspring.schemas import table_schema

AT = dt.datetime(2024, 1, 1)
LABELS = {"G1": "Small Ring exchange", "G2": "small bank", "G3": "Ringside, small & co", "G4": None, "G5": "", "G6": "BANK of the ring", "G7": "Ünion ring"}


def accounts(spark, labels, at=AT):
    rows = [{"address": a, "label": x, "verified": False, "updated_at": at} for a, x in labels.items()]
    return spark.createDataFrame(rows, table_schema("known_accounts"))


def addresses(df):
    return sorted(r["address"] for r in df.collect())


@pytest.mark.parametrize("compacted", [False, True])
def test_search_equals_a_scan(spark, tmp_path, compacted):
    folder = str(tmp_path)
    label_index.put_accounts(accounts(spark, LABELS), folder)
    label_index.put_accounts(accounts(spark, LABELS), folder)  # a replay
    changed = {"G2": "small ring bank", "G6": "closed", "G8": "rin"}
    label_index.put_accounts(accounts(spark, changed).unionByName(accounts(spark, {"G8": "older"}, dt.datetime(2023, 1, 1))), folder)
    if compacted:
        for table in ("known_accounts", "label_postings", "label_words"):
            assert deltas.compact(spark, folder, table) > 0
    now = accounts(spark, LABELS | changed)
    for terms in (["small"], ["Small", "ring"], ["bank", "ring", "closed"], ["absent"]):
        assert addresses(label_index.search(spark, folder, terms, every=False)) == addresses(rollups.label_search(now, "label", terms))
    assert addresses(label_index.search(spark, folder, ["small", "RING"])) == ["G1", "G2"]
    assert addresses(label_index.search(spark, folder, ["ring*", "small"])) == ["G1", "G2", "G3"]
    assert addresses(label_index.search(spark, folder, ["r*"])) == ["G1", "G2", "G3", "G7", "G8"]
    assert label_index.search(spark, folder, []).isEmpty() and label_index.search(spark, folder, [""]).isEmpty()
    entries = deltas.read(spark, folder, "label_postings")
    assert entries.groupBy("word", "address").count().filter("count > 1").isEmpty()
    assert sorted((r["word"], r["id"]) for r in label_index.postings(now, "address", "label").collect()) == sorted((r["word"], r["address"]) for r in entries.collect())


def test_search_of_nothing(spark, tmp_path):
    assert label_index.search(spark, str(tmp_path), ["small", "r*"]).isEmpty()


def test_a_crash_before_the_labels_hides_nothing(spark, tmp_path, monkeypatch):
    folder, put = str(tmp_path), deltas.put
    label_index.put_accounts(accounts(spark, {"G1": "small bank"}), folder)

    def crash(rows, folder, table):
        if table == "known_accounts":
            raise RuntimeError("lost")
        return put(rows, folder, table)

    monkeypatch.setattr(deltas, "put", crash)
    with pytest.raises(RuntimeError):
        label_index.put_accounts(accounts(spark, {"G1": "great ring"}), folder)
    monkeypatch.setattr(deltas, "put", put)
    assert addresses(label_index.search(spark, folder, ["bank"])) == ["G1"]
    assert addresses(label_index.search(spark, folder, ["ring"])) == []
    label_index.put_accounts(accounts(spark, {"G1": "great ring"}), folder)
    assert addresses(label_index.search(spark, folder, ["ring"])) == ["G1"] and label_index.search(spark, folder, ["bank"]).isEmpty()


def test_a_search_reads_the_buckets_of_its_words(spark, tmp_path):
    folder = str(tmp_path)
    many = spark.range(400).select(F.concat(F.lit("G"), "id").alias("address"), F.concat(F.lit("common word"), "id").alias("label"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in table_schema("known_accounts").fields[2:]))
    label_index.put_accounts(many, folder)
    deltas.compact(spark, folder, "label_postings")
    wanted = spark.createDataFrame([("word7",)], "word string")
    files = label_index._read(spark, folder, "label_postings", wanted).inputFiles()
    assert len(files) < len(deltas.read(spark, folder, "label_postings").inputFiles()) / 10
    assert addresses(label_index.search(spark, folder, ["common", "word7"])) == ["G7"]
