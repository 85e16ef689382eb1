"""The filter audit against its SQL, against a plain count of every order, and its tries against dicts."""

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspring.llm.filter_audit import Trie, audit, bounds, failures, masks
from tallyspring.llm.oracles import ORACLES
from tallyspring.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain_failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text))]
    return sum(t << i for i, t in enumerate(tests))


def plain_audit(docs, labels):
    """Every document run through every order."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    told = []
    for i, text, lang in docs:
        fails = {"ABCD"[k] for k in range(4) if plain_failures(text or "") >> k & 1} | ({"E"} if i is not None and least[text or ""] < i else set())
        good, toxic = (any(r[k] == 1 for r in labels if r[0] == i and i is not None) for k in (1, 2))
        told.append((lang or "", fails, good, toxic))
    out, by_filter = {}, {}
    for part in {t[0] for t in told}:
        mine = [t for t in told if t[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [t for t in left if x in t[1]]
                earlier = [t for t in mine if x in t[1] and set(order[: step - 1]) & t[1]]
                left = [t for t in left if x not in t[1]]
                out[part, order, step] = [len(left), len(gone), len(earlier), sum(t[1] == {x} for t in mine), sum(t[2] for t in gone), sum(t[3] for t in gone)]
                by_filter[part, x] = by_filter.get((part, x), 0) + len(gone)
    return sorted((p, o, s, *v, by_filter[p, o[s - 1]]) for (p, o, s), v in out.items())


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_equals_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_filter_audit']})").fetchall())
    found = QUERIES["op12_filter_audit"](spark, SF)
    assert rows_of(found) == expected and len(expected) % 600 == 0
    assert dict(found.dtypes)["step"] == "int" and dict(found.dtypes)["shapley"] == "bigint"


LONG = "Some Words of a long text that goes on and on. " * 3000
DOCS = [(1, None, None), (2, "", "en"), (3, "", None), (4, LONG, "en"), (5, LONG, "fr"), (5, LONG, "fr"), (6, LONG + "x", "en"), (None, LONG, "en"), (None, LONG, "en"), (7, "a # b", "en"), (7, "a # c", "en"), (-3, "a # b", ""), (8, "ÀÉ 日本", "ja"), (9, "\n\t ", "en")]
LABELS = [(4, 1, 0), (5, 1, 1), (5, 0, 0), (2, None, 1), (None, 1, 1), (99, 1, 1), (7, 0, 1)]


def frames(spark, docs=DOCS):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, mask int"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_odd_rows(spark):
    docs, labels = frames(spark)
    expected = plain_audit(DOCS, LABELS)
    assert rows_of(audit(docs, labels)) == expected
    assert rows_of(audit(docs.repartition(7), labels)) == expected
    assert audit(docs.limit(0), labels).count() == 0
    assert rows_of(audit(docs, labels.limit(0))) == plain_audit(DOCS, [])


def test_many_copies_and_shared_beginnings_over_small_tries(spark):
    r = random.Random(2)
    head = "the same beginning " * 50
    texts = [head + "".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(150)] + ["hot"] * 200 + [head[: r.randint(0, 200)] for _ in range(50)]
    docs = [(r.randint(0, 250), t, r.choice(["en", "fr", None])) for t in texts]
    df = frames(spark, docs)[0].repartition(5).select("text", "doc_id", "lang")
    least = {}
    for i, t, _ in docs:
        least[t] = min(i, least.get(t, i))
    expected = {}
    for i, t, lang in docs:
        key = (i, lang, plain_failures(t) | (16 if least[t] < i else 0))
        expected[key] = expected.get(key, 0) + 1
    for sizes in ({}, {"range_bytes": 2000, "trie_bytes": 3000}):
        found = masks(df, **sizes).groupBy("doc_id", "lang", "mask").agg(F.sum("n")).collect()
        assert {tuple(x[:3]): x[3] for x in found} == expected


def test_failures_of_bytes():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["a", "B", " ", "\n", "\x0b", "\xa0", "é", "日", "#", "w w "]) for _ in range(r.randint(0, 900)))
        assert failures(text.encode()) == plain_failures(text)


@pytest.mark.parametrize("seed", range(5))
def test_trie_holds_least_ids(seed):
    r, trie, plain = random.Random(seed), Trie(), {}
    for _ in range(500):
        text = bytes(r.choice(b"ab") for _ in range(r.randint(0, 7)))
        i = r.randint(0, 1000)
        trie.insert(text, i, None, None)
        plain[text] = min(i, plain.get(text, i))
    assert {t: n.least for t, n in trie.walk()} == plain
    assert sum(trie.told.values()) + sum(sum(n.rows.values()) for n in trie.terminals()) == 500


def test_bounds_are_the_shortest_that_part_neighbours():
    shared = b"x" * 1000
    texts = [shared + bytes([97 + i]) * 50 for i in range(20)] + [b"b", b"c"]
    cuts = bounds(texts, 5)
    assert cuts == sorted(cuts) and len(cuts) == 4 and all(len(c) <= 1001 for c in cuts)
    sizes = [sum(len(t) for t in texts if (k == 0 or t >= cuts[k - 1]) and (k == 4 or t < cuts[k])) for k in range(5)]
    assert max(sizes) < 2 * sum(sizes) / 5
    assert bounds([], 4) == [] == bounds([b"same"] * 9, 4)
