"""Byte-pair encoding and decoding with a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that merging gives. It starts with one state that all bytes lead
back to; each merge (u, v), in order, is one gadget: the state that u leads to is copied without its v arc, u leads to
the copy from now on, and every state with a u arc gets an arc of the joined token to where v leads. All arcs of a
token lead to one state, and an arc, once there, is never taken away, so a state is its original, the token that it
lacks, and the merge that made it, and no arc lists are copied: tens of thousands of merges compile in a second, to a
few arrays bounded by the vocabulary.

A pre-split word is encoded by following arcs that spell it. No two paths spell the same bytes, so each place of the
word is reached at most once and the search, longest arc first, takes time linear in the word. Decoding emits the
labels of the arcs. Tokenizer files are read, never trained.
"""

from __future__ import annotations

import functools
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspring.llm.token_count import PRE_TOKENS
from tallyspring.llm.vocabulary import UNSURE, byte_of, library, model
from tallyspring.llm.words import coded, row_slices, row_sums, whole_rows

#: Words and arcs that a task remembers; when so many are known, they are forgotten and found anew.
REMEMBERED = 1 << 18
#: Later than any merge.
NEVER = 1 << 60


class Automaton:
    """States are numbers; state 0 is the start, with an arc for every token that can stand first."""

    def __init__(self, alphabet: dict[int, bytes], merges: Iterable[tuple[int, int, int]]):
        """``alphabet``: label of each token that is not made by a merge; ``merges``: (left, right, joined) in order."""
        self.label = dict(alphabet)
        self.left, self.rank = dict.fromkeys(alphabet, -1), dict.fromkeys(alphabet, -1)
        self.target = dict.fromkeys(alphabet, 0)
        self.parent, self.lacks, self.born = [0], [-1], [-1]
        for rank, (u, v, joined) in enumerate(merges):
            self._gadget(rank, u, v, joined)
        self._index()

    def _gadget(self, rank: int, u: int, v: int, joined: int) -> None:
        if u not in self.label or v not in self.label:  # a part that never comes up
            return
        if joined in self.label:
            raise ValueError(f"token {joined} is made by two merges")
        state, goes = self.target[u], self.target[v]
        if not self._has_arc(state, v):
            return
        self.parent.append(state)
        self.lacks.append(v)
        self.born.append(rank)
        self.target[u] = len(self.parent) - 1
        self.label[joined] = self.label[u] + self.label[v]
        self.left[joined], self.rank[joined], self.target[joined] = u, rank, goes

    def _has_arc(self, state: int, token: int) -> bool:
        """A token that is older than the state is there unless the state or an original lacks it, a newer one if its left part is."""
        while token >= 0:
            rank = self.rank[token]
            while state and self.born[state] > rank:
                if self.lacks[state] == token:
                    return False
                state = self.parent[state]
            token = self.left[token]
        return True

    def _index(self) -> None:
        """Tables for quick transitions: states in the order of a walk from originals to copies, and for each token the ranges of states that lack it."""
        copies: list[list[int]] = [[] for _ in self.parent]
        for s in range(1, len(self.parent)):
            copies[self.parent[s]].append(s)
        enter, leave, at, todo = [0] * len(copies), [0] * len(copies), 0, [(0, False)]
        while todo:
            s, done = todo.pop()
            if done:
                leave[s] = at
                continue
            enter[s] = at
            at += 1
            todo.append((s, True))
            todo += [(c, False) for c in copies[s]]
        ranges: dict[int, list[tuple[int, int, int]]] = {}
        for s in range(1, len(self.parent)):
            ranges.setdefault(self.lacks[s], []).append((enter[s], leave[s], self.born[s]))
        self.cuts = {token: tuple(zip(*sorted(r), strict=True)) for token, r in ranges.items()}
        self.place = {token: enter[s] for token, s in self.target.items()}
        self.token = {label: token for token, label in self.label.items()}
        reach: dict[bytes, int] = {}
        for label in self.token:
            if len(label) > 2:
                reach[label[:3]] = max(reach.get(label[:3], 2), len(label))
        self.reach = reach
        self.known: dict[int, bool] = {}

    def follows(self, before: int, token: int) -> bool:
        """Whether the state that ``before`` leads to has an arc of ``token``."""
        place, above = self.place[before], NEVER
        while token >= 0:
            cut = self.cuts.get(token)
            if cut is not None:
                k = bisect_right(cut[0], place) - 1
                if k >= 0 and place < cut[1][k] and cut[2][k] <= above:
                    return False
            above, token = self.rank[token], self.left[token]
        return True

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The labels' tokens of the one path that spells the word."""
        token_of, reach = self.token.get, self.reach.get
        whole = token_of(word)
        if whole is not None:  # the start has every arc
            return (whole,)
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        n, at, state, path, places = len(word), 0, -1, [], []
        end = min(n, reach(word[:3], 2))
        while at < n:
            while end > at:
                token = token_of(word[at:end])
                if token is not None:
                    if state < 0:
                        break
                    arc = state << 32 | token
                    told = known.get(arc)
                    if told is None:
                        told = known[arc] = self.follows(state, token)
                    if told:
                        break
                end -= 1
            if end > at:
                path.append(token)
                places.append(at)
                state, at = token, end
                end = at + reach(word[at : at + 3], 2)
                if end > n:
                    end = n
            elif path:  # no arc goes on from here
                path.pop()
                at, end, state = places.pop(), at - 1, path[-1] if path else -1
            else:
                raise ValueError("a byte has no token")
        return tuple(path)


class Codec:
    """Texts to ids and back, as the tokenizer library does with a byte-level file."""

    def __init__(self, path: str):
        file = model(path)
        kind, cut = file["model"], file["pre_tokenizer"]
        plain = cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        if kind["type"] != "BPE" or not plain or file["normalizer"] or file["decoder"]["type"] != "ByteLevel" or kind.get("ignore_merges") or kind.get("dropout"):
            raise ValueError(f"{path} isn't a byte-level file of the plain kind")
        added = file["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens with conditions aren't supported")
        self.byte = byte_of()
        self.special = {t["content"]: t["id"] for t in added}
        self.cut_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if added else None
        vocabulary = kind["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in kind["merges"]]
        made = {a + b for a, b in pairs}
        raw = {t: bytes(self.byte[c] for c in t) for t in vocabulary if t not in self.special}
        alphabet = {vocabulary[t]: r for t, r in raw.items() if t not in made and len(r) == 1}
        self.automaton = Automaton(alphabet, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])
        self.find = re.compile(PRE_TOKENS).findall
        self.split = library(path).pre_tokenizer.pre_tokenize_str
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        found = self.known[word] = self.automaton.encode(word.encode())
        return found

    def segment(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        out: list[int] = []
        if UNSURE.search(text):  # characters whose class may differ: the library cuts
            for shown, _ in self.split(text):
                out += self.automaton.encode(bytes(map(self.byte.__getitem__, shown)))
            return out
        get = self.known.get
        for word in self.find(text):
            out += get(word) or self.word(word)
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        out, at = array("I"), 0
        for hit in self.cut_special.finditer(text) if self.cut_special else ():
            out.extend(self.segment(text[at : hit.start()]))
            out.append(self.special[hit[0]])
            at = hit.end()
        out.extend(self.segment(text[at:]))
        return np.frombuffer(out, np.uint32).astype("<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The same of many texts. They are cut at single blanks between two other characters, where no word can run
        across, and each distinct piece is encoded once."""
        offsets, codes, distinct = coded(pc.split_pattern(texts, " "))
        firsts = codes[offsets[:-1]]
        unsafe = np.array([not p or p[0].isspace() or p[-1].isspace() or any(s in p for s in self.special) for p in distinct], np.int64)
        whole = np.flatnonzero(row_sums(unsafe[codes], offsets))
        # a text's first piece has no blank before it
        ids = [() if u else self.segment(" " + p) for p, u in zip(distinct, unsafe, strict=True)] + [() if unsafe[c] else self.segment(distinct[c]) for c in firsts]
        codes = codes.copy()
        codes[offsets[:-1]] = len(distinct) + np.arange(len(firsts))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum()))
        starts, each = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.cumsum(each)
        found = flat[np.repeat(starts[codes] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[offsets]
        out = [found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for row in whole.tolist():
            out[row] = self.encode(texts[row].as_py())
        return out


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


@functools.cache
def labels(path: str) -> dict[int, bytes]:
    """What the arcs of each token spell; decoding needs no more of the automaton."""
    file, byte = model(path), byte_of()
    special = {t["id"]: t["content"].encode() for t in file["added_tokens"]}
    return {i: bytes(byte[c] for c in t) for t, i in file["model"]["vocab"].items() if i not in special} | special


def text_of(ids: bytes, path: str) -> str:
    """Labels in a row, read as UTF-8; bytes that aren't become U+FFFD, and unknown ids nothing, as in the library."""
    get = labels(path).get
    return b"".join([get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def encode(df: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """One row per input row: row (the input row, a struct) and ids (binary, little-endian unsigned 32-bit numbers).

    The ids are the tokenizer library's for the whole text without begin and end tokens. Null and empty texts have no
    ids; special strings in texts are their one id. Ids of rows may be null or repeat, columns may have any name.
    """
    rows = whole_rows(df)
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = codec(path).encode_all
        for part in row_slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(to_ids(part.column(1)), pa.binary())], names=["row", "ids"])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The input's columns and the text of its ids; null ids give an empty text."""
    if out_col in df.columns:
        raise ValueError(f"{out_col} is there already")
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])
    k = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [text_of(x or b"", path) for x in part.column(k).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ids and of the text decoded from them: id, n_tokens, ids_sha256, decoded_sha256."""
    coded = encode(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path).select(F.col("row.id").alias(id_col), "ids")
    told = decode(coded, path)
    return told.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
