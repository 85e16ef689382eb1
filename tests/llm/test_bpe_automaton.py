"""The tokenization automaton against the library, against plain merging, and against its literal construction."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallyspring.llm.bpe_automaton import Automaton, codec, decode, encode, labels, round_trip, text_of
from tallyspring.llm.vocabulary import library

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "aa", "the", " ", "  ", "\n", " \n", "<|endoftext|>", "<|", "é", "中", "\0", "'s", "12", "_", "-", "ing", "zz", "e", "́", "😀", "İ", "\xa0", "\x85", "\x1c", " a", "b "]


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def merged(word, merges):
    """Plain merging: the earliest pair in the list first, from left to right."""
    parts = list(word)
    for left, right, joined in merges:
        out = []
        while parts:
            if parts[:2] == [left, right]:
                out.append(joined)
                parts = parts[2:]
            else:
                out.append(parts.pop(0))
        parts = out
    return tuple(parts)


def literal(alphabet, merges):
    """The automaton with all its arcs written out: a state is a dict of token to state."""
    arcs = [{t: 0 for t in alphabet}]
    for left, right, joined in merges:
        via = {s[left] for s in arcs if left in s and right in arcs[s[left]]}
        copy_of, goes = {}, {q: arcs[q][right] for q in via}
        for q in via:
            copy_of[q] = len(arcs)
            arcs.append({t: s for t, s in arcs[q].items() if t != right})
        for s in arcs:
            if s.get(left) in via:
                q = s[left]
                s[left], s[joined] = copy_of[q], goes[q]
    return arcs


def random_merges(r, letters, n):
    known, merges = {bytes([97 + i]): i for i in range(letters)}, []
    while len(merges) < n:
        a, b = r.choice(list(known)), r.choice(list(known))
        if a + b not in known and len(a + b) < 7:
            known[a + b] = len(known)
            merges.append((known[a], known[b], known[a + b]))
    return merges


@pytest.mark.parametrize("seed", range(30))
def test_random_merges(seed):
    r = random.Random(seed)
    letters = r.choice([1, 2, 3])
    alphabet = {i: bytes([97 + i]) for i in range(letters)}
    merges = random_merges(r, letters, 4 if letters == 1 else 15)
    auto, arcs = Automaton(alphabet, merges), literal(alphabet, merges)
    for token in auto.label:
        state = arcs[0].get(token)
        assert state is not None
        assert {t for t in auto.label if auto.follows(token, t)} == set(arcs[state])
    for _ in range(300):
        word = bytes(97 + r.randrange(letters) for _ in range(r.randint(1, 14)))
        assert auto.encode(word) == merged([c - 97 for c in word], merges), (word, merges)


def test_every_entry_and_random_texts_as_in_the_library():
    c, lib, r = codec(PATH), library(PATH), random.Random(5)
    assert set(c.automaton.label) | set(c.special.values()) == set(lib.get_vocab().values())  # every token comes up
    assert all(labels(PATH)[t] == label for t, label in c.automaton.label.items())
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(5000)] + ["".join(chr(r.randint(97, 122)) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    texts += ["x" * 50_000, "".join(chr(r.randint(97, 122)) for _ in range(50_000)), "\n" * 3000, "-" * 3000]
    expected = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    coded = c.encode_all(pa.array(texts, pa.large_string()))
    assert [ids_of(x) for x in coded] == expected
    assert [text_of(x, PATH) for x in coded] == texts
    for _ in range(500):  # ids in any order, whose bytes may not be UTF-8, and ids that aren't there
        ids = [r.randint(0, 50_300) for _ in range(8)]
        assert text_of(np.array(ids, "<u4").tobytes(), PATH) == lib.decode(ids, skip_special_tokens=False)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: r for r in round_trip(docs, PATH).collect()}
    assert len(found) == docs.count()
    for row in docs.select("doc_id", "text").collect():
        e = library(PATH).encode(row["text"] or "", add_special_tokens=False)
        back = library(PATH).decode(e.ids, skip_special_tokens=False)
        expected = (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert tuple(found[row["doc_id"]])[1:] == expected


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "", None), (2, "a b", "y"), (3, "Z" * 300_000, None)], "doc_id long, text string, ids string")
    rows = encode(odd, PATH).collect()
    assert sorted((r["row"]["doc_id"] or 0, len(r["ids"]) // 4) for r in rows)[:4] == [(0, 0), (1, 0), (1, 0), (2, 2)] and {r["row"]["ids"] for r in rows} == {"x", "y", None}
    told = {r["doc_id"]: r["n_tokens"] for r in round_trip(odd, PATH).collect()}
    assert told[2] == 2 and told[3] == len(library(PATH).encode("Z" * 300_000).ids) and told[None] == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert round_trip(empty, PATH).count() == 0
    assert decode(spark.createDataFrame([(None,)], "ids binary"), PATH).first()["decoded"] == ""
    with pytest.raises(ValueError, match="there already"):
        decode(spark.createDataFrame([(b"", "x")], "ids binary, decoded string"), PATH)
