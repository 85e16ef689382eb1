"""Arrow helpers: a column of texts as integer codes of its distinct pieces.

Per-piece work in the operators is done once for each distinct piece of a slice of rows;
what remains for every occurrence is a numpy gather.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once. A longer single text makes a slice of its own.
SLICE_BYTES = 4 << 20


def release() -> None:
    """Gives freed memory back to the system. A worker stays for the next stages, and what it holds counts for its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of about ``most`` bytes of text; null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(column)
        texts = pc.fill_null(batch.column(k).cast(pa.large_string()), "")
        batch = pa.RecordBatch.from_arrays([texts if i == k else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch, texts
        release()


def whole_rows(df: DataFrame) -> DataFrame:
    """The rows as one struct column ``row``, so that columns added beside it can't clash with theirs."""
    return df.select(F.struct("*").alias("row"))


def row_slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``slices`` of rows of ``whole_rows``, with the columns row and text."""

    def with_text() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            yield pa.RecordBatch.from_arrays([row, pc.struct_field(row, [row.type.get_field_index(text_col)])], names=["row", "text"])

    return slices(with_text(), most=most)


def coded(lists: pa.LargeListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of a list of strings for each row: the offsets of rows, the code of each string, the distinct strings."""
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    found = flat.dictionary_encode()
    return offsets - offsets[0], found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``coded`` for the runs of characters outside ``[\\x20\\x09-\\x0D]``."""
    offsets, codes, distinct = coded(pc.ascii_split_whitespace(texts))
    if "" in distinct:  # at the ends of texts
        keep = codes != distinct.index("")
        offsets, codes = np.concatenate([[0], np.cumsum(keep)])[offsets], codes[keep]
    return offsets, codes, distinct


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between offsets, along the first axis."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]
