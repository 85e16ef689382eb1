"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

1. The share of all documents that hold a five-word shingle is counted in a sketch of fixed size (hashed counters, two
   rows, 8 MB), which is sent to the tasks. Its noise is a share of the documents too, so weights are alike at any size.
2. Every document gets consistent weighted samples of its TF-IDF shingles. Documents with the same words in the same
   order form a class, a node from here on.
3. Nodes that share a band of samples are a bucket. Of the first nodes of its buckets, a node is verified against the
   one that most of its samples agree with. That settles groups of near copies with one comparison for each node.
4. What is left are buckets with nodes of several components. There, and only between components, all samples are
   compared, each pair in the first band that it shares, and the nodes of pairs that agree are compared exactly, by
   products of sparse blocks. Rows are dealt to tasks of bounded size; the largest component of a bucket is never
   compared with itself.
5. Components of the verified links are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspring.llm.components import components
from tallyspring.llm.shingles import MOST_ROWS, STEP, levels, sampler, shingled
from tallyspring.llm.storage import cut
from tallyspring.llm.words import slices

SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Agreeing samples (of BANDS * ROWS) under which a pair isn't verified. At a similarity of 0.8 the number is binomial
#: with mean 51; it falls under this once in a million pairs.
ALIKE = 36
#: Counters of a row of the sketch, and of a segment in which counters travel; partial sketches that are added at once.
COUNTERS, SEGMENT, FAN_IN = 1 << 20, 1 << 14, 256
#: A block of nodes holds about this many, or this many words.
BLOCK_ROWS, BLOCK_WORDS = 256, 400_000


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, most=4 << 20):
        for at in range(0, part.num_rows, MOST_ROWS):
            yield part.slice(at, MOST_ROWS)


# shares of documents


def counters(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(COUNTERS - 1)).astype(np.int64), ((hashes >> np.uint64(25)) & np.uint64(COUNTERS - 1)).astype(np.int64) + COUNTERS


NARROW = [np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.int64)]


def narrow(counts: np.ndarray) -> tuple[int, bytes]:
    """Counts in the narrowest numbers that hold them."""
    kind = next(i for i, t in enumerate(NARROW) if counts.max() <= np.iinfo(t).max)
    return kind, counts.astype(NARROW[kind]).tobytes()


def frequencies(docs: DataFrame) -> np.ndarray:
    """The sketch of document frequencies, over all documents. Partial sketches are added ``FAN_IN`` at a time, so no
    task gets one from every other task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(2 * COUNTERS, np.int64), False
        for part in small(batches):
            any_row = True
            for k, at in enumerate(counters(shingled(part.column(1)).hashes)):
                total[k * COUNTERS : (k + 1) * COUNTERS] += np.bincount(at - k * COUNTERS, minlength=COUNTERS)
        if any_row:
            parts = total.reshape(-1, SEGMENT)
            filled = np.flatnonzero(parts.any(1))
            kinds, told = zip(*(narrow(parts[k]) for k in filled), strict=True) if len(filled) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(kinds, pa.int32()), pa.array(told, pa.binary())], names=["segment", "kind", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SEGMENT, np.int64)
        for kind, x in zip(table.column("kind").to_pylist(), table.column("counts"), strict=True):
            total += np.frombuffer(x.as_py(), NARROW[kind])
        kind, told = narrow(total)
        return pa.table({"part": table.column("part")[:1], "segment": table.column("segment")[:1], "kind": pa.array([kind], pa.int32()), "counts": pa.array([told], pa.binary())})

    sketches = docs.select("doc_id", "text").mapInArrow(count, "segment int, kind int, counts binary").withColumn("part", F.spark_partition_id())
    for _ in range(3):  # up to FAN_IN ** 3 tasks
        sketches = sketches.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        sketches = sketches.groupBy("part", "segment").applyInArrow(add, "part int, segment int, kind int, counts binary")
    out = np.zeros((2 * COUNTERS // SEGMENT, SEGMENT), np.int64)
    for row in sketches.toLocalIterator():  # 128 rows
        out[row["segment"]] += np.frombuffer(row["counts"], NARROW[row["kind"]])
    return out.reshape(-1)


class Weights:
    """Weights of shingles, from the sketch of their shares of all documents."""

    def __init__(self, spark: SparkSession, docs: DataFrame):
        sketch = frequencies(docs).astype(np.float64)
        self.n = docs.count()
        # a counter's mean noise, which is taken off, is what other shingles put there
        rows = sketch.reshape(2, COUNTERS)
        noise = (rows.sum(1, keepdims=True) - rows) / (COUNTERS - 1)
        shares = np.maximum(rows - noise, 1) / max(self.n, 1)
        self.shares = spark.sparkContext.broadcast(shares.reshape(-1).astype(np.float32))

    def of(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        a, b = counters(hashes)
        return levels(times, np.minimum(self.shares.value[a], self.shares.value[b]), self.n)


# samples and buckets


def text_hashes(text: Column) -> list[Column]:
    """Two hashes of a text, null as empty: with the id, what tells documents apart."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def text_key(text: Column) -> Column:
    """The key of a text in the result of ``near_duplicates``."""
    return F.concat_ws(":", *text_hashes(text))


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, hashes of the text, digests of the words, n_words, samples (binary, 4 bytes each)."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sampler(BANDS * ROWS)
        for part in small(batches):
            s = shingled(part.column(1))
            samples = of.samples(s.hashes, weights.of(s.hashes, s.times), s.offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *part.columns[2:], *(pa.array(d.view(np.int64)) for d in s.digests), pa.array(s.n_words.astype(np.int64)), pa.array([x.tobytes() for x in samples], pa.binary())],
                names=["doc_id", "h1", "h2", "d1", "d2", "n_words", "samples"],
            )

    keyed = docs.select("doc_id", "text", *text_hashes(F.col("text")))
    return keyed.mapInArrow(sample, "doc_id bigint, h1 bigint, h2 bigint, d1 bigint, d2 bigint, n_words bigint, samples binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node) of the bands that several nodes share, and the first node of each as hub."""
    width = 4 * ROWS
    keys = F.array(*(F.substring("samples", i * width + 1, width) for i in range(BANDS)))
    banded = nodes.select("node", F.posexplode(keys).alias("band", "key")).select("node", "band", F.xxhash64("band", "key").alias("key"))
    crowded = cut(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1").select(F.col("key").alias("key2"), "hub"))
    return cut(banded.join(crowded, F.col("key") == F.col("key2")).select("key", "band", "node", "hub"))


def hub_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hub, agree): nodes and the first nodes of their buckets, with the number of agreeing samples if enough."""
    pairs = members.filter("node != hub").select("node", "hub").distinct().join(nodes.select("node", "samples"), "node")
    pairs = pairs.join(nodes.select(F.col("node").alias("hub"), F.col("samples").alias("its")), "hub")
    places = F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1))
    agree = F.size(F.filter(places, lambda i: F.substring("samples", i * 4 + 1, F.lit(4)) == F.substring("its", i * 4 + 1, F.lit(4))))
    return pairs.select("node", "hub", agree.alias("agree")).filter(F.col("agree") >= ALIKE)


# exact verification


def set_unit() -> Column:
    """The part of a block that a node's set takes."""
    return F.lit(1.0 / BLOCK_ROWS) + F.col("n_words") / F.lit(float(BLOCK_WORDS))


def shingle_sets(docs: DataFrame, firsts: DataFrame, which: DataFrame, weights: Weights) -> DataFrame:
    """(node, n_words, hashes, levels) of the nodes in ``which``; hashes rise, 8 bytes each, levels have one."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches):
            s = shingled(part.column(1))
            level = weights.of(s.hashes, s.times).astype(np.int8)
            cuts = list(zip(s.offsets.tolist(), s.offsets[1:].tolist(), strict=False))
            sets = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (s.hashes, level)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.n_words.astype(np.int64)), *sets], names=["node", "n_words", "hashes", "levels"])

    wanted = firsts.join(which.select("node").distinct(), "node")
    keyed = docs.select("doc_id", "text", *text_hashes(F.col("text")))
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2"))
    # rows that repeat would give their set again
    texts = keyed.join(wanted, same).select("node", "text").dropDuplicates(["node"])
    return cut(texts.mapInArrow(weigh, "node bigint, n_words bigint, hashes binary, levels binary"))


def weighted(table: pa.Table, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and weights of rows of a table of sets."""
    hashes, lev = table.column("hashes").to_pylist(), table.column("levels").to_pylist()
    return [(np.frombuffer(hashes[k], np.uint64), STEP ** np.frombuffer(lev[k], np.int8).astype(np.float64)) for k in rows]


def enough(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether the sum of smaller weights is enough of the sum of larger ones; ``total`` is the sum of both."""
    return common * (1 + SIMILARITY) >= SIMILARITY * total * (1 - 1e-12)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs (node, hub) whose weighted Jaccard similarity is enough.

    A hub's pairs are dealt to as many tasks as their sets need, and its own set goes to each; small hubs share tasks.
    """
    sized = pairs.join(sets.select("node", "n_words"), "node").groupBy("hub").agg(F.sum(set_unit()).alias("size"))
    sized = cut(sized.select("hub", "size", F.ceil("size").cast("long").alias("salts")))
    bins = max(1, math.ceil(sized.filter("salts = 1").agg(F.sum("size")).first()[0] or 0))
    bin_ = F.when(F.col("salts") == 1, F.pmod(F.xxhash64("hub"), F.lit(bins))).otherwise(F.col("hub")).alias("bin")
    salt = lambda c: F.when(F.col("salts") == 1, F.lit(-1).cast("long")).otherwise(c).alias("salt")
    members = pairs.join(sized, "hub").select("node", "hub", bin_, salt(F.pmod(F.xxhash64("node"), F.col("salts"))))
    centres = sized.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select(F.col("hub").alias("node"), "hub", bin_, salt(F.col("k")))
    rows = members.union(centres).join(sets.drop("n_words"), "node")

    def compare(table: pa.Table) -> pa.Table:
        nodes, hubs = table.column("node").to_numpy(), table.column("hub").to_numpy()
        order = np.lexsort((nodes, nodes != hubs, hubs))  # each hub, then its nodes
        a, b = [], []
        for group in np.split(order, np.flatnonzero(np.diff(hubs[order])) + 1):
            sets_ = weighted(table, group)
            if nodes[group[0]] != hubs[group[0]] or len(group) < 2:
                continue
            own, its = sets_[0]
            row = np.repeat(np.arange(1, len(group)), [len(h) for h, _ in sets_[1:]])
            every, weight = (np.concatenate([s[k] for s in sets_[1:]]) for k in (0, 1))
            at = np.minimum(np.searchsorted(own, every), len(own) - 1)
            common = np.where(own[at] == every, np.minimum(its[at], weight), 0)
            good = enough(np.bincount(row, common, len(group)), np.bincount(row, weight, len(group)) + its.sum())
            for k in np.flatnonzero(good[1:]) + 1:
                a.append(nodes[group[k]]), b.append(hubs[group[k]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("bin", "salt").applyInArrow(compare, "a bigint, b bigint")


def gram_matrix(row: np.ndarray, hashes: np.ndarray, level: np.ndarray, n: int, chunk: int = 2048) -> np.ndarray:
    """For all pairs of n rows, the sum over common shingles of the smaller weight.

    A shingle whose weight varies is several features, one for each step between its weights, so that the smaller
    of two weights is the sum of their common steps. Shingles of one row only are left out.
    """
    _, code, seen = np.unique(hashes, return_inverse=True, return_counts=True)
    keep = seen[code] > 1
    row, code, level = row[keep], code[keep].astype(np.int64), level[keep].astype(np.int64)
    out = np.zeros((n, n), np.float64)
    if not len(row):
        return out
    steps, of = np.unique((code << 8) | (level + 128), return_inverse=True)
    weight, code = STEP ** ((steps & 255) - 128).astype(np.float64), steps >> 8
    new = np.concatenate([[True], code[1:] != code[:-1]])
    height = weight - np.where(new, 0, np.concatenate([[0], weight[:-1]]))
    rank = np.arange(len(steps)) - np.maximum.accumulate(np.where(new, np.arange(len(steps)), 0))
    times = rank[of] + 1
    feature = np.repeat(of, times) - (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    row = np.repeat(row, times)
    order = np.argsort(feature, kind="stable")
    feature, row = feature[order], row[order]
    root = np.sqrt(height)
    for at in range(0, len(steps), chunk):
        a, b = np.searchsorted(feature, [at, at + chunk])
        if a < b:
            x = np.zeros((n, min(chunk, len(steps) - at)))
            x[row[a:b], feature[a:b] - at] = root[feature[a:b]]
            out += x @ x.T
    return out


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    new, out = np.ones(len(links), bool), []
    for i in np.flatnonzero(links.any(1)):
        if not new[i]:
            continue
        new[i], stack = False, [int(i)]
        while stack:
            u = stack.pop()
            found = np.flatnonzero(links[u] & new)
            new[found] = False
            out += [(u, int(v)) for v in found]
            stack += found.tolist()
    return out


def dealt(rows: DataFrame, unit: Column) -> DataFrame:
    """Adds bin, i and j to rows (group, node, comp, ...): any two nodes of a group with different components meet in a
    task (bin, i, j), whose size is about two blocks.

    Small groups share a bin. The nodes of a larger group's greatest component are dealt apart from the others and meet
    those only, so a great component with few others costs one pass over it.
    """
    by_comp = rows.groupBy("group", "comp").agg(F.sum(unit).alias("size"))
    by_group = by_comp.groupBy("group").agg(F.max_by("comp", F.struct("size", "comp")).alias("major"), F.max("size").alias("most"), F.sum("size").alias("size"))
    ceiling = lambda c: F.greatest(F.ceil(c), F.lit(1)).cast("long")
    sizes = cut(by_group.select(F.col("group").alias("group2"), "major", "size", ceiling(F.col("size") - F.col("most")).alias("minors"), ceiling(F.col("most")).alias("majors")))
    bins = max(1, math.ceil(sizes.filter("size <= 1").agg(F.sum("size")).first()[0] or 0))
    placed = rows.join(sizes, F.col("group") == F.col("group2"))
    is_major = F.col("comp") == F.col("major")
    block = F.when(is_major, F.col("minors") + F.pmod(F.xxhash64("node"), F.col("majors"))).otherwise(F.pmod(F.xxhash64("node"), F.col("minors")))
    placed = placed.withColumn("block", block)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    task = lambda i, j: F.struct(F.col("group").alias("bin"), i.alias("i"), j.alias("j"))
    none = F.lit(-1).cast("long")
    shared = F.array(F.struct(F.pmod(F.xxhash64("group"), F.lit(bins)).alias("bin"), none.alias("i"), none.alias("j")))
    of_major = F.transform(upto(F.col("minors")), lambda i: task(i, F.col("block")))
    of_minor = F.concat(
        F.transform(upto(F.col("minors")), lambda j: task(F.least(F.col("block"), j), F.greatest(F.col("block"), j))), F.transform(upto(F.col("majors")), lambda k: task(F.col("block"), F.col("minors") + k))
    )
    tasks = F.explode(F.when(F.col("size") <= 1, shared).when(is_major, of_major).otherwise(of_minor)).alias("task")
    return placed.select(*rows.columns, tasks).select(*rows.columns, "task.*")


def in_groups(dealt_rows: DataFrame, links_of, told_of, schema: str) -> DataFrame:
    """What ``told_of`` makes of the links between different components, in each task and group.

    ``links_of`` gives the Boolean matrix of the links of some rows of a task's table; ``told_of`` gives columns from
    the task's table, the rows and the links.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def compare(table: pa.Table) -> pa.Table:
        nodes, groups, comps = (table.column(c).to_numpy() for c in ("node", "group", "comp"))
        order = np.lexsort((nodes, groups))
        out: list[tuple] = []
        for rows in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
            own = comps[rows]
            apart = own[:, None] != own[None, :]
            if apart.any() and (links := links_of(table, rows) & apart).any():
                out += told_of(groups[rows], nodes[rows], own, links)
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    return dealt_rows.groupBy("bin", "i", "j").applyInArrow(compare, schema)


def alike_samples(table: pa.Table, rows: np.ndarray) -> np.ndarray:
    """Pairs with enough agreeing samples, in the first band that they share."""
    column = table.column("samples").to_pylist()
    samples = np.array([np.frombuffer(column[k], np.uint32) for k in rows])
    agree, before = np.zeros((len(rows), len(rows)), np.uint8), np.zeros((len(rows), len(rows)), bool)
    band = table.column("band")[int(rows[0])].as_py()
    for k in range(BANDS):
        same = np.ones_like(before)
        for x in samples[:, k * ROWS : (k + 1) * ROWS].T:
            equal = x[:, None] == x[None, :]
            agree += equal
            same &= equal
        if k < band:
            before |= same
    return (agree >= ALIKE) & ~before


def alike_sets(table: pa.Table, rows: np.ndarray) -> np.ndarray:
    hashes, lev = table.column("hashes").to_pylist(), table.column("levels").to_pylist()
    h, level = [np.frombuffer(hashes[k], np.uint64) for k in rows], [np.frombuffer(lev[k], np.int8) for k in rows]
    row, every = np.repeat(np.arange(len(rows)), [len(x) for x in h]), np.concatenate(level)
    total = np.bincount(row, STEP ** every.astype(np.float64), len(rows))
    return enough(gram_matrix(row, np.concatenate(h), every, len(rows)), total[:, None] + total[None, :])


def with_component(rows: DataFrame, groups: DataFrame, node: str = "node", name: str = "comp") -> DataFrame:
    """Adds the component of a node; a node without links is its own."""
    known = groups.select(F.col("node").alias("known"), F.col("component").alias("its"))
    return rows.join(known, F.col(node) == F.col("known"), "left").withColumn(name, F.coalesce("its", node)).drop("known", "its")


def roots(parents: DataFrame) -> DataFrame:
    """(node, component) of every node of a forest, given as (a, b) with the one smaller node b that each a hangs on.

    Every round halves the way to the root. Only counts come to the driver.
    """
    now = cut(parents.select(F.col("a").alias("node"), F.col("b").alias("component")))
    while True:
        above = now.select(F.col("node").alias("known"), F.col("component").alias("its"))
        moved = now.join(above, F.col("component") == F.col("known"), "left")
        moved = cut(moved.select("node", F.coalesce("its", "component").alias("component"), F.col("its").isNotNull().alias("moved")))
        if moved.filter("moved").isEmpty():
            return now.union(now.select(F.col("component").alias("node"), "component").distinct())
        now = moved.drop("moved")


def verified_groups(docs: DataFrame, nodes: DataFrame, weights: Weights) -> DataFrame:
    """(node, component) of the nodes with links. ``nodes``: node, first (id and hashes of a text), n_words, samples."""
    members = buckets(nodes)
    best = cut(hub_pairs(members, nodes).groupBy("node").agg(F.max_by("hub", F.struct("agree", "hub")).alias("hub")))
    sets = shingle_sets(docs, nodes.select("node", "first"), best.select("node").union(best.select("hub")), weights)
    hung = cut(roots(verified(best, sets)))

    told = cut(with_component(members.select("key", "band", "node"), hung))
    open_ = told.groupBy("key").agg((F.min("comp") != F.max("comp")).alias("open")).filter("open").select(F.col("key").alias("key2"))
    rows = told.join(open_, F.col("key") == F.col("key2")).select(F.col("key").alias("group"), "band", "node", "comp").join(nodes.select("node", "samples"), "node")
    with_links = lambda groups, those, comps, links: [(int(groups[0]), int(those[k]), int(comps[k])) for k in np.flatnonzero(links.any(1))]
    rows = dealt(rows.select("group", "band", "node", "comp", "samples"), F.lit(1.0 / BLOCK_ROWS))
    rows = cut(in_groups(rows, alike_samples, with_links, "group bigint, node bigint, comp bigint").distinct())
    sets = shingle_sets(docs, nodes.select("node", "first"), rows, weights)
    rows = rows.join(sets, "node").select("group", "node", "comp", "n_words", "hashes", "levels")
    forest = lambda groups, those, comps, links: [(int(comps[u]), int(comps[v])) for u, v in spanning(links)]
    joined = components(in_groups(dealt(rows, set_unit()), alike_sets, forest, "a bigint, b bigint"))
    # components of the forest that links between them join, and nodes that hung on nothing
    moved = joined.select(F.col("node").alias("known"), F.col("component").alias("its"))
    both = hung.join(moved, F.col("component") == F.col("known"), "left").select("node", F.coalesce("its", "component").alias("component"))
    return both.union(joined.join(hung.select("node"), "node", "left_anti").select("node", "component"))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id, n_words, kept, text_key.

    Documents are linked when their weighted Jaccard similarity is 0.8 or more, and grouped by chains of links.
    ``class_id`` is the smallest id of the document's group; ``kept`` is true for one document of each group, which has
    that id. A null or empty text, or one of blanks, is in a group of its own. Rows with equal id and text count as one
    document. Rows with equal ids and different texts are different documents, which ``text_key`` (of the text) tells
    apart; only groups of such documents may have equal class ids. An id must be an integer; rows without one are in no
    group and come back with a null class and kept. Other columns are left out.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = rows.filter(F.col("doc_id").isNotNull())
    weights = Weights(spark, docs)
    signed = cut(signatures(docs, weights))
    same = ["d1", "d2", "n_words"]
    document = F.struct("doc_id", "h1", "h2")
    classes = cut(signed.filter("n_words > 0").groupBy(*same).agg(F.min(document).alias("first"), F.first("samples").alias("samples")))
    # numbers are given to written rows and written with them, so that they stay
    nodes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    groups = cut(verified_groups(docs, nodes.select("node", "first", "n_words", "samples"), weights))
    named = with_component(nodes.select("node", "first", *same), groups)
    firsts = named.groupBy("comp").agg(F.min("first").alias("group_first"))
    named = cut(named.join(firsts, "comp").select(*(F.col(c).alias(f"c_{c}") for c in same), "group_first"))
    members = signed.select("doc_id", "h1", "h2", *same).distinct()
    joined = members.join(named, [F.col(c) == F.col(f"c_{c}") for c in same], "left").withColumn("group_first", F.coalesce("group_first", document))
    out = joined.select("doc_id", F.col("group_first.doc_id").alias("class_id"), "n_words", (document == F.col("group_first")).alias("kept"), F.concat_ws(":", "h1", "h2").alias("text_key"))
    nothing = F.lit(None).cast("long")
    nameless = rows.filter(F.col("doc_id").isNull()).select("doc_id", nothing.alias("class_id"), nothing.alias("n_words"), F.lit(True).alias("kept"), text_key(F.col("text")).alias("text_key"))
    return out.union(nameless).withColumnRenamed("doc_id", id_col)
