"""Audit of five filters in every order, with exact duplicates found by radix tries.

Every task inserts its texts into a compressed trie that holds at each terminal the least id, so of the copies in a task
one goes on and the others are told as duplicates at once. What goes on is dealt by ranges of texts, cut at adaptive
prefixes: the shortest ones that part neighbours of a sorted sample, which are long where many texts begin alike. Each
range is a trie again, and a walk over it gives the flags. What is left of a document is a mask of the filters that it
fails; masks are counted, and all orders are derived from at most 32 counts for each part.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspring.llm.words import slices

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Texts of the sample from which ranges are cut; results don't depend on it.
SAMPLE = 16_000
#: Bytes of texts in a range, about, and in a task's first trie before it is emptied.
RANGE_BYTES, TRIE_BYTES = 32 << 20, 64 << 20
#: Bytes of a node beside its text, about.
NODE_BYTES = 400
#: Bytes of texts in a batch that a task gives.
BATCH_BYTES = 8 << 20

CAPITALS, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
#: Bytes that go on with a character.
GOES_ON = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails, from its UTF-8 bytes. ``bytes.split`` cuts at the six ASCII blanks."""
    words = text.split()
    short = len(words) < 200
    repeats = 100 * len(set(words)) < 50 * len(words)
    points = len(text.translate(None, GOES_ON))
    capitals = 100 * (len(text) - len(text.translate(None, CAPITALS))) > 3 * points
    symbols = len(text.translate(None, SYMBOLS)) < len(text)
    return short | repeats << 1 | capitals << 2 | symbols << 3


class Node:
    """``edges``: first byte to (label, node). At a terminal: the text's mask, the least id, and the rows with it."""

    __slots__ = ("edges", "least", "mask", "rows")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, Node]] | None = None
        self.rows: dict[str | None, int] | None = None
        self.mask = 0
        self.least = 0


def shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and of ``b`` from ``at`` on."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if b.startswith(a[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A compressed trie of texts. ``told`` gets (id, lang, mask) with a number of rows for every duplicate."""

    def __init__(self):
        self.told: dict[tuple[int | None, str | None, int], int] = {}
        self.clear()

    def clear(self) -> None:
        self.root, self.bytes = Node(), 0

    def terminal(self, text: bytes) -> Node:
        node, at, n = self.root, 0, len(text)
        while at < n:
            if node.edges is None:
                node.edges = {}
            edge = node.edges.get(text[at])
            if edge is None:
                leaf = Node()
                node.edges[text[at]] = (text[at:], leaf)
                self.bytes += n - at + NODE_BYTES
                return leaf
            label, child = edge
            if not text.startswith(label, at):
                k = shared(label, text, at)
                middle = Node()
                middle.edges = {label[k]: (label[k:], child)}
                node.edges[text[at]] = (label[:k], middle)
                child, label = middle, label[:k]
            node, at = child, at + len(label)
        return node

    def insert(self, text: bytes, doc_id: int, lang: str | None, mask: int | None, n: int = 1) -> None:
        node = self.terminal(text)
        if node.rows is None:
            node.rows, node.least, node.mask = {lang: n}, doc_id, failures(text) if mask is None else mask
        elif doc_id == node.least:
            node.rows[lang] = node.rows.get(lang, 0) + n
        elif doc_id > node.least:
            self.tell(doc_id, lang, node.mask | DUPLICATE, n)
        else:
            for other, m in node.rows.items():
                self.tell(node.least, other, node.mask | DUPLICATE, m)
            node.rows, node.least = {lang: n}, doc_id

    def tell(self, doc_id: int | None, lang: str | None, mask: int, n: int) -> None:
        key = (doc_id, lang, mask)
        self.told[key] = self.told.get(key, 0) + n

    def walk(self) -> Iterator[tuple[bytes, Node]]:
        """Texts and their terminals; a text is put together when its turn comes."""
        todo = [(b"", b"", self.root)]
        while todo:
            before, label, node = todo.pop()
            text = before + label
            if node.rows is not None:
                yield text, node
            todo += [(text, label, child) for label, child in (node.edges or {}).values()]

    def terminals(self) -> Iterator[Node]:
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.rows is not None:
                yield node
            todo += [child for _, child in (node.edges or {}).values()]


SCHEMA = "text binary, doc_id bigint, lang string, mask int, n bigint, part int"
ARROW = pa.schema([("text", pa.binary()), ("doc_id", pa.int64()), ("lang", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("part", pa.int32())])


class Out:
    """Rows on their way to Arrow batches of bounded size."""

    def __init__(self):
        self.rows, self.bytes = [], 0

    def add(self, text: bytes | None, *rest) -> pa.RecordBatch | None:
        self.rows.append((text, *rest))
        self.bytes += 64 + len(text or b"")
        return self.batch() if self.bytes > BATCH_BYTES else None

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(ARROW)
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)
        self.rows, self.bytes = [], 0
        return out


def bounds(texts: list[bytes], parts: int) -> list[bytes]:
    """At most parts - 1 prefixes, in order, that cut the sorted texts into ranges of about equal bytes: each is the
    shortest prefix of a text that is greater than the text before it."""
    ordered = sorted(set(texts))
    total, passed, out = sum(map(len, texts)), 0, []
    weight: dict[bytes, int] = {}
    for t in texts:
        weight[t] = weight.get(t, 0) + len(t) + 1
    total = sum(weight.values())
    for before, text in zip(ordered, ordered[1:]):
        passed += weight[before]
        if passed * parts >= total * (len(out) + 1) and len(out) < parts - 1:
            out.append(text[: len(os.path.commonprefix([before, text])) + 1])
    return out


def masks(docs: DataFrame, range_bytes: int = RANGE_BYTES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(doc_id, lang, mask, n): the filters that documents fail, duplicates table-wide, without their texts."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fraction = min(1.0, SAMPLE / max(1, docs.count()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for part in slices(batches) for t in part.column(0).cast(pa.large_binary()).to_pylist()]
        n = max(parts, int(sum(map(len, texts)) / fraction / range_bytes) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(bounds(texts, n), pa.binary())], names=["bound"])

    sample = docs.select("text").sample(fraction, seed=7) if fraction < 1 else docs.select("text")
    # one task, but never more than the sample; only the prefixes come to the driver
    edges = sorted(bytes(r[0]) for r in sample.repartition(1).mapInArrow(cut, "bound binary").collect())
    sent = spark.sparkContext.broadcast(edges)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), Out()

        def emptied() -> Iterator[pa.RecordBatch]:
            for text, node in trie.walk():
                part = bisect_right(sent.value, text)
                for lang, n in node.rows.items():
                    if (full := out.add(text, node.least, lang, node.mask, n, part)) is not None:
                        yield full
            for k, ((doc_id, lang, mask), n) in enumerate(trie.told.items()):
                if (full := out.add(None, doc_id, lang, mask, n, k % (len(sent.value) + 1))) is not None:
                    yield full
            trie.clear()
            trie.told = {}

        for part in slices(batches):
            ids, langs = part.column(1).to_pylist(), part.column(2).to_pylist()
            for text, doc_id, lang in zip(part.column(0).cast(pa.large_binary()).to_pylist(), ids, langs, strict=True):
                if doc_id is None:  # neither has a smaller one nor is one
                    trie.tell(None, lang, failures(text), 1)
                else:
                    trie.insert(text, doc_id, lang, None)
            if trie.bytes > trie_bytes or len(trie.told) > 1 << 18:
                yield from emptied()
        yield from emptied()
        yield out.batch()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), Out()
        for batch in batches:
            for text, doc_id, lang, mask, n, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is not None:
                    trie.insert(text, doc_id, lang, mask, n)
                elif (full := out.add(None, doc_id, lang, mask, n, 0)) is not None:
                    yield full
        for node in trie.terminals():
            for lang, n in node.rows.items():
                if (full := out.add(None, node.least, lang, node.mask, n, 0)) is not None:
                    yield full
        for (doc_id, lang, mask), n in trie.told.items():
            if (full := out.add(None, doc_id, lang, mask, n, 0)) is not None:
                yield full
        yield out.batch()

    dealt = docs.mapInArrow(first, SCHEMA).repartitionById(len(edges) + 1, "part")
    return dealt.mapInArrow(second, SCHEMA).select("doc_id", "lang", "mask", "n")


def total(masks_: Column, field: str, holds) -> Column:
    """Sum of a count over the masks for which a condition holds."""
    return F.aggregate(masks_, F.lit(0).cast("long"), lambda a, x: a + F.when(holds(x["mask"]), x[field]).otherwise(0))


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters: A under 200 words, B under half of the words distinct, C over 3 % capitals, D a symbol, E the text of a
    smaller id. A null text is empty, a null part is the empty string. Rows that repeat an id count each, and aren't
    duplicates of one another; a row without an id is no duplicate and makes none. A document is good (toxic) if any
    of its labels is 1. An empty table gives no rows. Other columns are left out.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.col(part_col).cast("string").alias("lang"))
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    told = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(flag(good_col).alias("good"), flag(toxic_col).alias("toxic"))
    known = masks(rows).join(told, "doc_id", "left").select(F.coalesce("lang", F.lit("")).alias("part"), "mask", "n", F.coalesce(F.col("good") * F.col("n"), F.lit(0)).alias("good"), F.coalesce(F.col("toxic") * F.col("n"), F.lit(0)).alias("toxic"))
    counted = known.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 32
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    each = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    each = each.withColumn("bit", F.expr("shiftleft(1, ascii(substr(filter_order, step, 1)) - 65)"))
    each = each.withColumn("earlier", F.expr("aggregate(sequence(1, 5), 0, (a, i) -> if(i < step, a | shiftleft(1, ascii(substr(filter_order, i, 1)) - 65), a))"))
    m, bit, earlier = F.col("masks"), F.col("bit"), F.col("earlier")
    fails = lambda x: x.bitwiseAND(bit) != 0
    before = lambda x: x.bitwiseAND(earlier) != 0
    # in how many of the 120 orders the filter comes first of those that a document fails
    share = lambda x: F.lit(120) / F.bit_count(x)
    shapley = F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + F.when(fails(x["mask"]), x["n"] * share(x["mask"]).cast("long")).otherwise(0))
    return each.select(
        "part", "filter_order", "step", total(m, "n", lambda x: ~fails(x) & ~before(x)).alias("kept"), total(m, "n", lambda x: fails(x) & ~before(x)).alias("removed"), total(m, "n", lambda x: fails(x) & before(x)).alias("redundant"),
        total(m, "n", lambda x: x == bit).alias("unique_fails"), total(m, "good", lambda x: fails(x) & ~before(x)).alias("good_lost"), total(m, "toxic", lambda x: fails(x) & ~before(x)).alias("toxic_lost"), shapley.alias("shapley"),
    )
