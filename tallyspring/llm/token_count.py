"""Token counts with a whole-token shortcut.

The vocabulary strings that encode alone as one token are proved once on the driver and sent to the
tasks (about 50,000 strings, bounded by the vocabulary). A text is cut at single blanks between two
other characters, where no pre-token can run across; the pre-tokens of each distinct piece that are
in the set count one, and only the rest are merged by the library.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspring.llm.vocabulary import UNSURE, library, rank_table, whole_tokens
from tallyspring.llm.words import coded, row_sums, slices

#: The pattern by which byte-level tokenizers of this family cut texts; a zero byte stands between pieces.
PRE_TOKENS = r"""\x00|'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s\x00]|_)+|\s+(?!\S)|\s+"""


class Counter:
    def __init__(self, path: str, whole: frozenset[str]):
        self.path = path
        self.one = dict.fromkeys(whole, 1) | {"\0": 0}
        self.find = re.compile(PRE_TOKENS).findall
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.ranks = rank_table(path)
        (self.zero,) = self.ranks.encode_ordinary("\0")

    def merged(self, rest: list[str]) -> np.ndarray:
        """Tokens of pre-tokens that are not one token."""
        ids = np.array(self.ranks.encode_ordinary("\0".join(rest) + "\0"))
        return np.diff(np.concatenate([[-1], np.flatnonzero(ids == self.zero)])) - 1

    def pieces(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece as it stands."""
        odd: list[int] = []
        if UNSURE.search("".join(pieces)):
            odd = [i for i, p in enumerate(pieces) if UNSURE.search(p)]
        if ends := [i for i, p in enumerate(pieces) if p[-1:].isspace()]:
            odd = sorted({*odd, *ends})
        plain = pieces
        if odd:
            at = set(odd)
            plain = ["" if i in at else p for i, p in enumerate(pieces)]
        found = self.find("\0".join(plain) + "\0")
        counts = list(map(self.one.get, found))
        if None in counts:
            at = [i for i, n in enumerate(counts) if n is None]
            counts = np.array([n or 0 for n in counts], np.int64)
            rest = pa.array([found[i] for i in at]).dictionary_encode()
            counts[at] = self.merged(rest.dictionary.to_pylist())[rest.indices.to_numpy()]
            breaks = np.array([x == "\0" for x in found])
        else:
            counts = np.array(counts, np.int64)
            breaks = np.array([x == "\0" for x in found])
        total = np.cumsum(counts)[breaks]
        out = np.diff(np.concatenate([[0], total]))
        if odd:
            out[odd] = [len(e.ids) for e in library(self.path).encode_batch_fast([pieces[i] for i in odd], add_special_tokens=False)]
        return out

    def text(self, text: str) -> int:
        """A text with runs of blanks, blank ends or special strings."""
        parts = self.cut(text)
        if "<|" in text or any(p[:1].isspace() or p[-1:].isspace() for p in parts[1:-1]) or UNSURE.search(text):
            return len(library(self.path).encode(text, add_special_tokens=False).ids)
        return int(self.pieces([parts[0], *(" " + p for p in parts[1:])]).sum())

    def texts(self, texts: pa.Array) -> np.ndarray:
        offsets, codes, distinct = coded(pc.split_pattern(texts, " "))
        counts = self.pieces([" " + p for p in distinct])
        out = row_sums(counts[codes], offsets)
        firsts = [distinct[c] for c in codes[offsets[:-1]]]
        out += self.pieces(firsts) - counts[codes[offsets[:-1]]]
        # a piece that is empty or has a blank at an end stands next to a cut that is not safe
        unsafe = np.array([not p or p[0].isspace() or p[-1].isspace() or "<|" in p for p in distinct], np.int64)
        for row in np.flatnonzero(row_sums(unsafe[codes], offsets)):
            out[row] = self.text(texts[int(row)].as_py())
        return out


@functools.cache
def counter(path: str, whole: frozenset[str]) -> Counter:
    return Counter(path, whole)


def count_tokens(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Ids may be null or repeat; each row is counted. Texts of any
    length are counted whole. Other columns of the input are left out.
    """
    spark = df.sparkSession
    whole = spark.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path, whole.value)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), pa.array(of.texts(part.column(1)))], names=[id_col, "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)[id_col]
    counted = rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
