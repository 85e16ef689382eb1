"""Packing of documents into training sequences: vector bin packing with the dot-product heuristic.

Every piece of a document has a demand vector (tokens, one segment, loss-bearing tokens); a sequence has a
limit in each dimension. A sequence is filled by taking, again and again, the piece with the largest dot
product of demand and remaining capacity among those that fit.

Each task packs the documents that it reads, in windows of a bounded number of tokens, so nothing is shuffled
and no document is tokenized twice. Sequences that a window leaves badly filled are opened again in the next
window. What is left badly filled at the end of a task is cut into sequences of power-of-two lengths, which
need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspring.llm.vocabulary import word_encoder
from tallyspring.llm.words import slices, words

MAX_TOKENS, MAX_SEGMENTS = 4096, 256
WINDOW_TOKENS = 6_000_000
#: A sequence filled less than this is opened again, or cut at the end of a task.
WELL_FILLED = 0.99


def fill(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> list[list[int]]:
    """Sequences as lists of piece numbers; every piece fits alone.

    Pieces of equal demand are interchangeable, so candidates are the distinct demands with their counts.
    Demands and capacities are taken as shares of the limits, each dimension weighted by the total demand.
    """
    if not len(tokens):
        return []
    demand, kind = np.unique(np.stack([tokens, np.ones_like(tokens), loss], 1), axis=0, return_inverse=True)
    order = np.argsort(kind, kind="stable")
    ends = np.cumsum(np.bincount(kind, minlength=len(demand)))
    left = np.diff(np.concatenate([[0], ends]))
    limit = np.array(limits, np.float64)
    shares = demand / limit
    weighted = shares * (shares * left[:, None]).sum(0)
    out, live = [], np.arange(len(demand))
    while len(live):
        free, at, chosen = np.array(limits, np.int64), live, []
        while len(at):
            k = at[np.argmax(weighted[at] @ (free / limit))]
            needs = demand[k] > 0
            n = int(min(left[k], (free[needs] // demand[k][needs]).min()))
            n = 1 if n > 1 and len(at) > 1 else n  # the weights change with what is free
            chosen += order[ends[k] - left[k] : ends[k] - left[k] + n].tolist()
            left[k] -= n
            free -= n * demand[k]
            at = at[(left[at] > 0) & (demand[at] <= free).all(1)]
        live = live[left[live] > 0]
        out.append(chosen)
    return out


def powers(length: int) -> list[int]:
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens, loss), where loss tells which ids bear loss; ``done`` gathers the
    rows of closed sequences."""

    def __init__(self, limits: tuple[int, int, int], first_sequence: int):
        self.limits, self.next = limits, first_sequence
        self.open: list[tuple] = []
        self.held = 0
        self.done: list[tuple] = []

    def document(self, doc_id, ids: np.ndarray, loss: np.ndarray) -> None:
        """Cuts a document into the longest pieces that fit a sequence alone."""
        n, start, total = len(ids), 0, np.concatenate([[0], np.cumsum(loss)])
        while start < n:
            # the last place up to which the loss-bearing ids fit
            end = min(start + self.limits[0], int(np.searchsorted(total, total[start] + self.limits[2], "right")) - 1)
            end = max(start + 1, end)
            piece = (doc_id, start, ids[start:end], n, loss[start:end])
            if end - start == self.limits[0]:
                self.close([piece])
            else:
                self.open.append(piece)
                self.held += end - start
            start = end

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, n, loss in pieces:
            self.done.append((doc_id, start, len(ids), n, self.next, at, int(loss.sum()), ids.tobytes()))
            at += len(ids)
        self.next += 1

    def pack(self, last: bool) -> None:
        tokens = np.array([len(p[2]) for p in self.open], np.int64)
        loss = np.array([p[4].sum() for p in self.open], np.int64)
        keep: list[tuple] = []
        for chosen in fill(tokens, loss, self.limits):
            pieces = [self.open[i] for i in chosen]
            total = int(tokens[chosen].sum())
            if total >= WELL_FILLED * self.limits[0]:
                self.close(pieces)
            elif last or len(pieces) == self.limits[1] or int(loss[chosen].sum()) == self.limits[2]:
                self.cut(pieces, total)  # at another limit a sequence can't be filled better
            else:
                keep += pieces
        self.open, self.held = keep, sum(len(p[2]) for p in keep)

    def cut(self, pieces: list[tuple], total: int) -> None:
        """The pieces in a row, as sequences of power-of-two lengths."""
        pieces = pieces[::-1]
        for size in powers(total):
            row = []
            while size:
                doc_id, start, ids, n, loss = pieces.pop()
                if len(ids) > size:
                    pieces.append((doc_id, start + size, ids[size:], n, loss[size:]))
                    ids, loss = ids[:size], loss[:size]
                row.append((doc_id, start, ids, n, loss))
                size -= len(ids)
            self.close(row)


def pack(
    df: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts_col: str | None = None,
    end_id: int = 2,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_TOKENS,
) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, loss_tokens, ids (little-endian uint32).

    All ids of a document bear loss but its first, which nothing predicts. With ``parts_col``, an array of structs (text,
    loss), a document is its parts in a row instead, each encoded on its own, and only the ids of the parts whose ``loss``
    is true bear loss, with the end id if the last part does; that is the form of prompts and answers. A null part, text or
    loss counts as empty or false.

    A null or empty text is one piece that holds the end id only. Ids may be null or repeat; each row is a document
    of its own. Sequence numbers hold the partition's number in the upper bits, so they are unique and the same again
    when a lost task is run anew. Other columns of the input are left out. A limit under 1 is an error.
    """
    limits = (max_tokens, max_segments, max_loss)
    if min(limits) < 1:
        raise ValueError(f"limits {limits} leave no room for a piece")
    texts, loss = F.col(text_col), F.lit(None).cast("array<boolean>")
    if parts_col is not None:
        parts = F.coalesce(F.col(parts_col), F.array().cast("array<struct<text:string,loss:boolean>>"))
        texts, loss = F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), F.transform(parts, lambda p: F.coalesce(p["loss"], F.lit(False)))
    joined = texts if parts_col is None else F.array_join(texts, "")  # tells a slice its size
    rows = df.select(F.col(id_col).alias("doc_id"), joined.alias("text"), *([] if parts_col is None else [texts.alias("texts"), loss.alias("loss")]))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        packer, id_type = Packer(limits, TaskContext.get().partitionId() << 36), None

        def rows_out(flush: bool) -> Iterator[pa.RecordBatch]:
            while packer.done and (flush or len(packer.done) >= 5000):
                part, packer.done = packer.done[:5000], packer.done[5000:]
                columns = list(zip(*part, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"])

        for part in slices(batches):
            id_type = part.schema.field(0).type
            if parts_col is None:
                texts, in_row = part.column(1), np.arange(part.num_rows + 1)
            else:
                texts, in_row = part.column(2).flatten(), part.column(2).offsets.to_numpy().astype(np.int64)
                in_row = in_row - in_row[0]
            offsets, codes, distinct = words(texts)
            ids, cuts = encoder.encode(distinct)
            lengths = np.diff(cuts)[codes]
            ends = np.cumsum(lengths)
            in_text = np.concatenate([[0], ends])[offsets]
            everything = ids[np.repeat(cuts[:-1][codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = in_text[in_row]
            closed = np.insert(everything, bounds[1:], np.uint32(end_id))
            if parts_col is None:
                mask = np.ones(len(closed), bool)
            else:
                flags = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(bool)
                at_end = np.where(np.diff(in_row) > 0, np.concatenate([flags, [False]])[np.maximum(in_row[1:] - 1, 0)], False)
                mask = np.insert(np.repeat(flags, np.diff(in_text)), bounds[1:], at_end)
            bounds = bounds + np.arange(len(bounds))
            mask[bounds[:-1]] = False
            for doc_id, a, b in zip(part.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                packer.document(doc_id, closed[a:b].copy(), mask[a:b].copy())
            if packer.held >= WINDOW_TOKENS:
                packer.pack(last=False)
            yield from rows_out(flush=False)
        packer.pack(last=True)
        yield from rows_out(flush=True)

    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
