"""Hard negatives by an inverted multi-index with certified stops.

Vectors are cut into two halves, each with a codebook, and a row lies in the cell of its two nearest codewords. No row
of a cell scores higher with an anchor than its two half-scores, codeword plus the anchor's length times the radius,
add up to. Rows are dealt by cells into shards, a crowded cell into several. An anchor goes only to shards whose best
cell can still reach what a bounded sample of rows has certified for it, and in a shard a heap visits cells by falling
bound until no cell left can change the answer. So the result is exact, whatever the codebooks and the sample are.

Two rounds: the best rows of the anchor's label, then for each of those the best other rows in its window of scores.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspring.llm.storage import cut

#: Rows of the sample that codebooks are fitted on and first thresholds are read from, about.
SAMPLE = 4096
#: Rows of a cell on average, codewords of a half at most, and rows of a shard at least and at most.
CELL, CODES, SHARD = 256, 64, (1024, 65_536)
#: Whole components are smaller than this, so that scores fit 64 bits.
LARGEST = 1 << 24
#: Largest sum of products that float arithmetic keeps exact.
EXACT = 1 << 52
NOTHING = -math.inf


def codebook(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centres by plain k-means; fewer where points repeat."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)]
    for _ in range(rounds):
        near = nearest(points, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre, and the distance to it."""
    near = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, 1)
    return near, np.linalg.norm(points - centres[near], axis=1)


def wide(lists: pa.Array, dim: int) -> np.ndarray:
    """Lists of whole numbers as the rows of an array, zeros behind the shorter ones."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    sizes, flat = np.diff(offsets), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dim), np.int64)
    at = np.repeat(np.arange(len(lists)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, rows by anchors."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * max(1, rows.shape[1])
    if most < EXACT:
        return np.rint(rows.astype(np.float64) @ anchors.T.astype(np.float64)).astype(np.int64)
    return rows @ anchors.T


class Index:
    """Codebooks and the catalogue of cells: sent to all tasks, at most CODES squared cells."""

    def __init__(self, dim: int, sample: tuple[np.ndarray, np.ndarray, np.ndarray], n: int):
        self.dim, self.half = dim, (dim + 1) // 2
        k = int(max(1, min(CODES, round(math.sqrt(n / CELL)))))
        self.sample_ids, self.sample_labels, self.sample = sample
        points = self.sample.astype(np.float64) if len(self.sample) else np.zeros((1, dim))
        self.books = codebook(points[:, : self.half], k), codebook(points[:, self.half :], k)

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = q.astype(np.float64)
        return f[:, : self.half], f[:, self.half :]

    def cells(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row, and its distances to the two codewords."""
        (a, da), (b, db) = (nearest(x, book) for x, book in zip(self.halves(q), self.books, strict=True))
        return a * len(self.books[1]) + b, da, db

    def catalogue(self, cells: list[tuple[int, int, float, float]], shard_rows: int) -> None:
        """Lays cells (number, rows, two radii) out over shards: neighbours together, a crowded one over several."""
        self.cell, size, self.r1, self.r2 = (np.array(c, t) for c, t in zip(zip(*sorted(cells), strict=True), (np.int64, np.int64, float, float), strict=True))
        self.first, self.spread, shard, filled = np.zeros(len(size), np.int64), np.ones(len(size), np.int64), 0, 0
        for k, n in enumerate(size.tolist()):
            if filled and filled + n > shard_rows:
                shard, filled = shard + 1, 0
            self.first[k], self.spread[k] = shard, max(1, -(-n // shard_rows))
            if self.spread[k] > 1:
                shard, filled = shard + int(self.spread[k]), 0
            else:
                filled += n
        self.shards = int((self.first + self.spread).max())

    def shard_of(self, cell: np.ndarray, row: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.cell, cell)
        return self.first[at] + row % self.spread[at]

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor with any row of each cell."""
        middle, reach = np.zeros((len(q), len(self.cell))), np.zeros((len(q), len(self.cell)))
        for x, book, code, radius in zip(self.halves(q), self.books, divmod(self.cell, len(self.books[1])), (self.r1, self.r2), strict=True):
            middle += (x @ book.T)[:, code]
            reach += np.linalg.norm(x, axis=1)[:, None] * radius
        reach += slack(middle, reach)
        return middle - reach, middle + reach


def slack(*parts: np.ndarray) -> np.ndarray:
    """More than rounding can take from a bound."""
    return 1 + 1e-9 * sum(np.abs(p) for p in parts)


class Shard:
    """The rows of a shard by cell, label and id, with radii of its own."""

    def __init__(self, index: Index, q: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        cell, d1, d2 = index.cells(q)
        order = np.lexsort((ids, labels, cell))
        self.q, self.ids, self.labels = q[order], ids[order], labels[order]
        cell, d1, d2 = cell[order], d1[order], d2[order]
        if len(q) * index.dim and float(np.abs(q).max()) ** 2 * index.dim < EXACT:
            self.q = self.q.astype(np.float64)
        self.largest = float(np.abs(q).max(initial=0))
        codes = divmod(cell, len(index.books[1]))
        (self.i, at_i), (self.j, at_j) = np.unique(codes[0], return_inverse=True), np.unique(codes[1], return_inverse=True)
        self.books = index.books[0][self.i], index.books[1][self.j]
        self.radii = np.zeros(len(self.i)), np.zeros(len(self.j))
        np.maximum.at(self.radii[0], at_i, d1)
        np.maximum.at(self.radii[1], at_j, d2)
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(cell)]
        self.place = {(int(at_i[a]), int(at_j[a])): (int(a), int(b)) for a, b in zip(starts, ends, strict=True)}

    def visits(self, halves: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[float, float, int, int]]:
        """Cells by falling bound: (greatest and least score possible, first row, end), over the sorted half-scores."""
        if not self.place:
            return
        middle = [book @ x for x, book in zip(halves, self.books, strict=True)]
        reach = [np.linalg.norm(x) * r for x, r in zip(halves, self.radii, strict=True)]
        reach = [r + slack(m, r) for m, r in zip(middle, reach, strict=True)]
        order = [np.argsort(-(m + r)).tolist() for m, r in zip(middle, reach, strict=True)]
        high = [(m + r)[o].tolist() for m, r, o in zip(middle, reach, order, strict=True)]
        low = [(m - r)[o].tolist() for m, r, o in zip(middle, reach, order, strict=True)]
        heap, seen = [(-(high[0][0] + high[1][0]), 0, 0)], {(0, 0)}
        while heap:
            bound, a, b = heapq.heappop(heap)
            place = self.place.get((order[0][a], order[1][b]))
            if place:
                yield -bound, low[0][a] + low[1][b], *place
            for x, y in ((a + 1, b), (a, b + 1)):
                if x < len(order[0]) and y < len(order[1]) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(high[0][x] + high[1][y]), x, y))

    def scored(self, anchor: np.ndarray, start: int, end: int) -> np.ndarray:
        if self.q.dtype == np.float64 and self.largest * float(np.abs(anchor).max(initial=0)) * len(anchor) < EXACT:
            return np.rint(self.q[start:end] @ anchor.astype(np.float64)).astype(np.int64)
        return self.q[start:end].astype(np.int64) @ anchor

    def mine(self, start: int, end: int, label: int) -> tuple[int, int]:
        """Where the label's rows lie in a cell."""
        low, high = np.searchsorted(self.labels[start:end], [label, label + 1])
        return start + int(low), start + int(high)


class Best:
    """The k best (score, id) of a window of scores, higher scores first, then smaller ids. ``least`` is the least score
    that could still come in."""

    def __init__(self, k: int, least: float, most: float):
        self.k, self.least, self.most, self.rows = k, least, most, []

    def add(self, s: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero((s >= self.least) & (s <= self.most))
        if len(at) > self.k:
            at = at[np.lexsort((ids[at], -s[at]))[: self.k]]
        if len(at):
            self.rows = sorted([*self.rows, *zip((-s[at]).tolist(), ids[at].tolist(), strict=True)])[: self.k]
            if len(self.rows) == self.k:
                self.least = max(self.least, -self.rows[-1][0])


def usable(vector: Column, scale: int) -> Column:
    inside = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float(LARGEST)))
    return F.coalesce(vector.isNotNull() & inside, F.lit(False))


def mine(
    df: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is their whole inner product. An anchor's positives are its first rows of
    the same label by falling score, then rising id; a positive's negatives are the first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Null labels, vectors, components and ids, and
    components that aren't finite or reach 2**24 after scaling, keep a row out. In vectors of unlike length the missing
    components count as 0. Rows that repeat are rows of their own, but a row with the anchor's id is no positive, and a
    repeated anchor counts once. Anchors without a positive or a negative give no rows. Other columns are left out.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"), scale))
    rows = rows.select("id", "label", "anchor", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("q"))
    n, dim = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n or not dim:  # vectors without components score 0 with all others: nothing is told apart
        dim = 1
    if not n:
        return spark.createDataFrame([], schema)
    seen = rows.sample(min(1.0, SAMPLE / n), seed=11).select("id", "label", "q").collect() if n > SAMPLE else rows.select("id", "label", "q").collect()
    lists = pa.array([r["q"] for r in seen], pa.list_(pa.int32()))
    index = Index(dim, (np.array([r["id"] for r in seen], np.int64), np.array([r["label"] for r in seen], np.int64), wide(lists, dim)), n)
    start = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            if b.num_rows:
                cell, d1, d2 = start.value.cells(wide(b.column(3), dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(d1), pa.array(d2), pa.array(np.arange(at, at + b.num_rows))], names=[*b.schema.names, "cell", "d1", "d2", "row"])
                at += b.num_rows

    # written, as shards and bounds are of the very rows that are searched
    placed = cut(rows.mapInArrow(place, "id bigint, label bigint, anchor boolean, q array<int>, cell bigint, d1 double, d2 double, row bigint"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = placed.groupBy("cell").agg(F.count("*"), F.max("d1"), F.max("d2")).collect()  # at most CODES squared
    index.catalogue([tuple(c) for c in cells], max(SHARD[0], min(SHARD[1], -(-n // parts))))
    sent = spark.sparkContext.broadcast(index)
    anchors = placed.filter("anchor").select("id", "label", "q").distinct().withColumn("key", F.xxhash64("id", "label", "q"))

    row_schema = "shard int, kind int, id bigint, key bigint, label bigint, q array<int>, windows array<struct<score:bigint,least:double>>"
    arrow = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("label", pa.int64()), ("q", pa.list_(pa.int32())), ("windows", pa.list_(pa.struct([("score", pa.int64()), ("least", pa.float64())])))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = sent.value.shard_of(b.column(3).to_numpy(), b.column(4).to_numpy())
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.zeros(m), pa.int32()), b.column(0), pa.nulls(m, pa.int64()), b.column(1), b.column(2), pa.nulls(m, arrow.field("windows").type)], schema=arrow)

    def sent_to(told: list[tuple], q: np.ndarray, windows: list[list[tuple[int, float]]]) -> Iterator[pa.RecordBatch]:
        """Rows of anchors for the shards that can hold something for them. A window is (greatest score, least score that helps)."""
        ix = sent.value
        least, most = ix.ranges(q)
        need = np.array([min(w[1] for w in ws) for ws in windows])
        top = np.array([max(w[0] for w in ws) for ws in windows], float)
        useful = (most >= need[:, None]) & (least <= top[:, None])
        for k, (id_, key, label_, vector) in enumerate(told):
            hit = np.flatnonzero(useful[k])
            shards = np.unique(np.concatenate([np.arange(a, a + s) for a, s in zip(ix.first[hit], ix.spread[hit], strict=True)])) if len(hit) else hit
            each = [{"score": s, "least": t} for s, t in windows[k]]
            m = len(shards)
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), *(pa.array([x] * m, f.type) for x, f in zip((1, id_, key, label_, vector, each), list(arrow)[1:], strict=True))], schema=arrow)

    def routed(windows_of: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    b = batch.slice(at, 512)
                    q = wide(b.column(3), dim)
                    known = scores(q, sent.value.sample)
                    told = list(zip(*(c.to_pylist() for c in b.columns[:4]), strict=True))
                    wanted = b.column(4).to_pylist() if b.num_columns > 4 else [None] * b.num_rows
                    windows = [windows_of(sent.value, t[0], t[2], s, w) for t, s, w in zip(told, known, wanted, strict=True)]
                    yield from sent_to(told, q, windows)

        return run

    def first_windows(ix: Index, id_: int, label_: int, s: np.ndarray, _: None) -> list[tuple[int, float]]:
        same = s[(ix.sample_labels == label_) & (ix.sample_ids != id_)]
        least = float(np.partition(same, len(same) - positives)[len(same) - positives]) if len(same) >= positives else NOTHING
        return [(np.iinfo(np.int64).max, least)]

    def second_windows(ix: Index, _: int, label_: int, s: np.ndarray, wanted: list[int]) -> list[tuple[int, float]]:
        other, out = s[ix.sample_labels != label_], []
        for p in sorted(set(wanted)):
            lowest, highest = -(-low * p // 100), high * p // 100
            inside = other[(other >= lowest) & (other <= highest)]
            out.append((p, float(np.partition(inside, len(inside) - negatives)[len(inside) - negatives]) if len(inside) >= negatives else float(lowest)))
        return out

    def searched(answer: Callable) -> Callable:
        """Rows of the shard come first, then its anchors, a batch at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, shard = [], None
            for batch in batches:
                kind = batch.column(1).to_numpy()
                split = int(np.searchsorted(kind, 1))
                if split:
                    held.append(batch.slice(0, split))
                asked = batch.slice(split)
                if not asked.num_rows:
                    continue
                if shard is None:
                    if not held:
                        return
                    whole = pa.Table.from_batches(held).combine_chunks()
                    shard = Shard(sent.value, wide(whole.column("q").combine_chunks(), dim), whole.column("id").to_numpy(), whole.column("label").to_numpy())
                    held = []
                q = wide(asked.column(5), dim)
                halves = sent.value.halves(q)
                found = []
                for k, (id_, key, label_, windows) in enumerate(zip(*(asked.column(c).to_pylist() for c in (2, 3, 4, 6)), strict=True)):
                    found += [(id_, key, *x) for x in answer(shard, id_, label_, q[k], (halves[0][k], halves[1][k]), windows)]
                columns = zip(*found, strict=True) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "key", "of", "found", "score"])

        return run

    def same_label(shard: Shard, id_: int, label_: int, q: np.ndarray, halves: tuple, windows: list[dict]) -> Iterator[tuple[int, int, int]]:
        best = Best(positives, windows[0]["least"], math.inf)
        for bound, _, start_, end in shard.visits(halves):
            if bound < best.least:
                break
            a, b = shard.mine(start_, end, label_)
            if a < b:
                others = shard.ids[a:b] != id_
                best.add(shard.scored(q, a, b)[others], shard.ids[a:b][others])
        return ((0, i, -s) for s, i in best.rows)

    def other_labels(shard: Shard, _: int, label_: int, q: np.ndarray, halves: tuple, windows: list[dict]) -> Iterator[tuple[int, int, int]]:
        wanted = [(w["score"], Best(negatives, w["least"], high * w["score"] // 100)) for w in windows]
        top = max(b.most for _, b in wanted)
        for bound, least, start_, end in shard.visits(halves):
            if bound < min(b.least for _, b in wanted):
                break
            if least > top:
                continue
            a, b = shard.mine(start_, end, label_)
            for x, y in ((start_, a), (b, end)):
                if x < y:
                    s = shard.scored(q, x, y)
                    for _, best in wanted:
                        best.add(s, shard.ids[x:y])
        return ((p, i, -s) for p, best in wanted for s, i in best.rows)

    def search(asked: DataFrame, answer: Callable) -> DataFrame:
        both = placed.select("id", "label", "q", "cell", "row").mapInArrow(deal, row_schema).unionByName(asked)
        return both.repartitionById(index.shards, "shard").sortWithinPartitions("kind").mapInArrow(searched(answer), "anchor_id bigint, key bigint, of bigint, found bigint, score bigint")

    def ranked(found: DataFrame, most: int, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    asked = anchors.select("id", "key", "label", "q").mapInArrow(routed(first_windows), row_schema)
    chosen = cut(ranked(search(asked, same_label), positives, "anchor_id", "key").select("anchor_id", "key", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))
    with_windows = anchors.join(chosen.groupBy(F.col("key").alias("k"), F.col("anchor_id").alias("a")).agg(F.collect_set("positive_score").alias("wanted")), (F.col("key") == F.col("k")) & (F.col("id") == F.col("a")))
    asked = with_windows.select("id", "key", "label", "q", "wanted").mapInArrow(routed(second_windows), row_schema)
    hits = ranked(search(asked, other_labels), negatives, "anchor_id", "key", "of").select(F.col("anchor_id").alias("a"), F.col("key").alias("k"), F.col("of").alias("p"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    out = chosen.join(hits, (F.col("anchor_id") == F.col("a")) & (F.col("key") == F.col("k")) & (F.col("positive_score") == F.col("p")))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
