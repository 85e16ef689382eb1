"""Hard negatives against their SQL and against all pairs, with small cells and shards, ties, hot vectors and odd rows."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspring.llm import hard_negatives
from tallyspring.llm.hard_negatives import Best, Index, Shard, mine, scores
from tallyspring.llm.oracles import ORACLES
from tallyspring.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int, score double, id string"


def plain(rows, k=5):
    """All pairs; rows: (id, vector, label), one for each id."""
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], lab) for i, v, lab, *_ in rows if None not in (i, v, lab) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, a, lab in ok:
        if i % 100 == 0:
            told = sorted((-sum(x * y for x, y in zip(a, b)), j, other) for j, b, other in ok if j != i)
            for s, p, _ in [t for t in told if t[2] == lab][:k]:
                negatives = [t for t in told if t[2] != lab and 80 * -s <= 100 * -t[0] <= 100 * -s][:k]
                out += [(i, p, n, j, -s, -t) for n, (t, j, _) in enumerate(negatives, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def run(spark, rows):
    df = spark.createDataFrame([(i, v, lab, 0.5, "x") for i, v, lab in rows], SCHEMA).repartition(3)
    return rows_of(mine(df, F.col("vec_id") % 100 == 0))


def test_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    expected = sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op11_hard_negatives']})").fetchall())
    found = QUERIES["op11_hard_negatives"](spark, SF)
    assert rows_of(found) == expected and expected
    assert [t for _, t in found.select(*COLUMNS).dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs_over_small_cells_and_shards(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "SHARD", (40, 60))
    monkeypatch.setattr(hard_negatives, "CELL", 8)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 100)
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 7))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.3 * r.normal(size=7)], int(r.integers(0, 3))) for i in range(420)]
    # a third of the rows are one vector, in several labels, so scores tie
    rows += [(1000 + i, rows[5][1], i % 3) for i in range(200)]
    assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    v = [0.5, 0.5]
    rows = [(0, v, 1), (1, v, 1), (2, v, 1), (3, [0.45, 0.5], 2), (4, None, 1), (5, v, None), (6, [float("nan"), 1.0], 2), (7, [float("inf"), 0.0], 2), (8, [None, 1.0], 2), (None, v, 2), (100, [0.0, 0.0], 1), (200, [-0.5, -0.5], 7), (9, [0.0, 0.0], 2)]
    assert run(spark, rows) == plain(rows)
    # repeated rows are rows; a row with the anchor's id is no positive; a repeated anchor counts once
    assert run(spark, [(0, v, 1), (0, v, 1), (1, v, 1), (1, v, 1), (2, v, 2)]) == [(0, 1, 1, 2, 32768, 32768)] * 2
    # components that one vector lacks count as 0, and one that is too large keeps its row out
    assert run(spark, [(0, [1.0], 1), (1, [1.0, 9.0], 1), (2, [1.0, 0.0], 2), (3, [1e30, 0.0], 1), (4, [], 2)]) == [(0, 1, 1, 2, 65536, 65536)]
    assert run(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 1, 1, 2, 0, 0)]
    assert rows_of(mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0)) == []
    assert run(spark, [(1, v, 1)]) == [] == run(spark, [(0, v, 1)])


def test_bounds_hold_and_fall():
    r = np.random.default_rng(4)
    q = r.integers(-300, 300, (500, 9))
    index = Index(9, (np.arange(50), np.zeros(50, np.int64), q[:50]), 5000)
    cell, d1, d2 = index.cells(q)
    index.catalogue([(int(c), int((cell == c).sum()), d1[cell == c].max(), d2[cell == c].max()) for c in np.unique(cell)], 30)
    shards = index.shard_of(cell, np.arange(500))
    assert shards.max() + 1 == index.shards > 5 and np.bincount(shards).max() <= 60
    low, high = index.ranges(q[:20])
    for k in range(20):
        s = scores(q, q[k : k + 1])[:, 0]
        at = np.searchsorted(index.cell, cell)
        assert (low[k][at] <= s).all() and (s <= high[k][at]).all()
    shard = Shard(index, q, np.arange(500), r.integers(0, 3, 500))
    for k in range(20):
        halves = tuple(h[0] for h in index.halves(q[k : k + 1]))
        visits = list(shard.visits(halves))
        assert sorted(x for v in visits for x in range(v[2], v[3])) == list(range(500))
        assert [v[0] for v in visits] == sorted((v[0] for v in visits), reverse=True)
        for bound, least, a, b in visits:
            s = shard.scored(q[k], a, b)
            assert (least <= s).all() and (s <= bound).all()


def test_best_rows_of_a_window():
    r = random.Random(3)
    rows = [(r.randint(0, 20), i) for i in range(200)]
    best = Best(5, 3, 15)
    for at in range(0, 200, 7):
        part = rows[at : at + 7]
        best.add(np.array([s for s, _ in part]), np.array([i for _, i in part]))
    assert best.rows == sorted((-s, i) for s, i in rows if 3 <= s <= 15)[:5]
    large = np.array([[1 << 23, -(1 << 23)]] * 2)
    assert scores(large, large)[0][0] == 2 * (1 << 46)
