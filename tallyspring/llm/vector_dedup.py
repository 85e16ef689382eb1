"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Vectors of one label are projected on many random directions. In each projection, sorted, a query's window holds the
vectors within ``WINDOW`` of it; a pair's collisions are the projections in which one lies in the other's window.
The number of collisions at a given distance is binomial, so the count to pass is calibrated for a recall of
``RECALL`` at the least cosine of a link. Pairs that pass are verified in double precision.

Equal vectors are one class, with a size. Classes are spread over cells, named by the sides of some further
projections; their number follows the largest label, and the number of tables follows so that a linked pair meets in
some table with ``RECALL``. A cell of more than a block is compared as pairs of blocks, so tasks stay bounded. A pair
counts in the first table where it meets. Tasks give sums of links and spanning forests, never all pairs.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspring.llm.components import components
from tallyspring.llm.storage import cut

COSINE = 0.98
PROJECTIONS, RECALL = 48, 0.9995
#: Rows of a block, and of a cell that isn't cut by a further projection, on average.
BLOCK, CELL = 512, 2048
#: Distance of unit vectors at the least cosine, and the window as a multiple of it.
DISTANCE = math.sqrt(2 - 2 * COSINE)
WINDOW = 0.5 * DISTANCE
#: Window entries that are gathered at once.
ENTRIES = 1 << 21


def passing_count(n: int, p: float, recall: float) -> int:
    """The largest count that a binomial(n, p) reaches with probability ``recall``."""
    tail = 0.0
    for k in range(n, 0, -1):
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail >= recall:
            return k
    return 0


#: A pair at the least cosine collides in a projection with this probability: a normal with deviation DISTANCE.
COLLIDES = 2 * NormalDist().cdf(WINDOW / DISTANCE) - 1
PASSING = passing_count(PROJECTIONS, COLLIDES, RECALL)


def tables_for(bits: int) -> int:
    """Tables of cells of so many sides in which a pair at the least cosine meets once with ``RECALL``."""
    meets = (1 - math.acos(COSINE) / math.pi) ** bits
    return 1 if meets >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - meets))


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, n))


def units(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # no square over- or underflows
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cells_of(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The cell of each row in each table."""
    if not bits:
        return np.zeros((len(unit), tables), np.int64)
    sides = (unit @ directions(unit.shape[1], bits * tables, 2) > 0).reshape(len(unit), tables, bits)
    return sides @ (1 << np.arange(bits, dtype=np.int64))


def collisions(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of the projections of queries and rows: in how many a row lies in the query's window.

    Only what lies in a window is touched: the sorted rows between a window's two ends, for every query.
    """
    n, m = len(queries), len(rows)
    out, waiting, held = np.zeros(n * m, np.int64), [], 0
    for q, r in zip(queries.T, rows.T, strict=True):
        order = np.argsort(r)
        low, high = np.searchsorted(r[order], q - WINDOW), np.searchsorted(r[order], q + WINDOW, "right")
        inside = high - low
        ends = np.cumsum(inside)
        at = np.arange(ends[-1]) + np.repeat(low - (ends - inside), inside)
        waiting.append(np.repeat(np.arange(n) * m, inside) + order[at])
        held += len(at)
        if held >= ENTRIES:
            out += np.bincount(np.concatenate(waiting), minlength=n * m)
            waiting, held = [], 0
    if held:
        out += np.bincount(np.concatenate(waiting), minlength=n * m)
    return out.reshape(n, m)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Numbers of the edges of a spanning forest."""
    parent, out = list(range(n)), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (u, v) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        u, v = find(u), find(v)
        if u != v:
            parent[u] = v
            out.append(k)
    return out


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def link_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors with equal labels, equal lengths and a cosine of 0.98 or more are linked; ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest id reachable. Vectors that are null, zero, or hold null or
    non-finite components, and those without a label, have no links. Repeated rows are linked like others; an id with several
    vectors is several rows, each with the links of its own vector. A row without an id has no links and comes back with a null component and kept. Other columns are left out.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    keyed = rows.filter("ok").withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v"), "dim": F.size("v")})
    same = ["label", "dim", "h1", "h2"]
    classes = cut(keyed.groupBy(*same).agg(F.min("vec_id").alias("first"), F.count("*").alias("size"), F.first("v").alias("v")))
    # a class is known by a number of its own, as an id may have several vectors; numbers are written with their rows
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    largest = classes.groupBy("label", "dim").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(largest / CELL))) if largest else 0
    tables = tables_for(bits)

    def place(batches):
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            vectors = batch.column(batch.schema.get_field_index("v"))
            cells = np.zeros((batch.num_rows, tables), np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                cells[at] = cells_of(units(flat.reshape(len(at), dim)), bits, tables)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    kind = dict(classes.dtypes)
    slim = classes.select("label", "dim", "rep", "size", "v")
    placed = slim.mapInArrow(place, f"label {kind['label']}, dim int, rep bigint, size bigint, v {kind['v']}, cells array<bigint>")
    in_cells = placed.select("label", "dim", "rep", "size", "v", F.posexplode("cells").alias("t", "cell"))
    key = ["label", "dim", "t", "cell"]
    counts = cut(in_cells.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")))
    counts = counts.select(*(F.col(c).alias(f"c_{c}") for c in key), "blocks")
    blocked = in_cells.join(counts, [F.col(c) == F.col(f"c_{c}") for c in key]).drop(*(f"c_{c}" for c in key)).withColumn("block", F.pmod(F.xxhash64("rep", "t"), F.col("blocks")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    tasks = blocked.select(*key, "rep", "size", "v", "block", F.explode(others).alias("p")).select(*key, "rep", "size", "v", "block", "p.*")

    def compare(group: pa.Table) -> pa.Table:
        t, dim = group.column("t")[0].as_py(), group.column("dim")[0].as_py()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        rep, size = group.column("rep").to_numpy(), group.column("size").to_numpy()
        order = np.argsort(rep)
        unit = units(group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[order])
        rep, size, block = rep[order], size[order], group.column("block").to_numpy()[order]
        projected = unit @ directions(dim, PROJECTIONS, 1)
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        a, b = np.nonzero(collisions(projected[left], projected[right]) >= PASSING)
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        if t:
            met = cells_of(unit, bits, tables)[:, :t]
            fresh = np.ones(len(a), bool)
            for at in range(0, len(a), 1 << 17):
                fresh[at : at + (1 << 17)] = ~(met[a[at : at + (1 << 17)]] == met[b[at : at + (1 << 17)]]).any(1)
            a, b = a[fresh], b[fresh]
        good = np.ones(len(a), bool)
        for at in range(0, len(a), 1 << 15):
            good[at : at + (1 << 15)] = np.einsum("ij,ij->i", unit[a[at : at + (1 << 15)]], unit[b[at : at + (1 << 15)]]) >= COSINE
        a, b = a[good], b[good]
        links = np.bincount(a, size[b], len(rep)) + np.bincount(b, size[a], len(rep))
        with_links = np.flatnonzero(links)
        edges = spanning(len(rep), a, b)
        return pa.table({
            "a": pa.array(np.concatenate([rep[with_links], rep[a[edges]]]), pa.int64()),
            "b": pa.array([*[None] * len(with_links), *rep[b[edges]].tolist()], pa.int64()),
            "n": pa.array(np.concatenate([links[with_links], np.zeros(len(edges))]).astype(np.int64)),
        })

    found = cut(tasks.groupBy(*key, "i", "j").applyInArrow(compare, "a bigint, b bigint, n bigint"))
    degrees = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    groups = components(found.filter("b is not null").select("a", "b"))
    known = classes.drop("v").join(degrees, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    known = cut(known)
    smallest = known.groupBy(F.col("component").alias("c2")).agg(F.min("first").alias("component_id"))
    known = known.join(smallest, F.col("component") == F.col("c2"))
    known = cut(known.select(*(F.col(c).alias(f"k_{c}") for c in same), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    joined = keyed.select("vec_id", *same).join(known, [F.col(c) == F.col(f"k_{c}") for c in same]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return out.withColumnRenamed("vec_id", id_col)
