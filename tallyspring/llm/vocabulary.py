"""Reading of public tokenizer files, and fast exact encoding of short strings.

Where a string holds only characters on which Python's patterns and the tokenizer library are
known to agree (``SURE``, proved for every one of them in the tests), the split into pre-tokens
is done here; any other string goes to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A character outside the proved ranges.
UNSURE = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ɏΑ-ΡΤ-Ωα-ρσ-ωА-я‐-‧‰-⁞€一-龥]")


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def model(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(path: str, suffix: str = "", end: bytes = b"") -> dict[bytes, int]:
    """Bytes of each entry of the vocabulary; a final ``suffix`` becomes ``end``."""
    table = byte_of()
    vocabulary = model(path)["model"]["vocab"]
    out = {}
    for token, i in vocabulary.items():
        closed = suffix and token.endswith(suffix) and token != suffix
        raw = bytes(table[c] for c in (token[: -len(suffix)] if closed else token))
        out[raw + end if closed else raw] = i
    return out


@functools.cache
def whole_tokens(path: str) -> frozenset[str]:
    """Strings of the vocabulary that the library encodes alone as exactly one token: the offline proof of the shortcut."""
    strings = []
    for raw in token_bytes(path):
        try:
            strings.append(raw.decode())
        except UnicodeDecodeError:
            continue
    encoded = library(path).encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1)


def rank_table(path: str, suffix: str = "", end: bytes = b"", pattern: str = r"[^\x00]+|\x00"):
    """The vocabulary's merges as ranks.

    A table of ranks merges any two neighbours whose joined bytes are an entry, the library only the pair listed
    for it. The two agree when every entry, merged alone by the listed pairs, gives itself; ``test_vocabulary``
    proves that for all entries of the files in use.
    """
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=token_bytes(path, suffix, end), special_tokens={})


class WordEncoder:
    """Ids of blank-free chunks under a vocabulary with word ends, equal to the library's. The word end is a zero byte."""

    SPLIT = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, path: str):
        self.path = path
        self.table = rank_table(path, "</w>", b"\0", r"[^\x00]+\x00")
        self.line = token_bytes(path, "</w>", b"\0")[b"\n\0"]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all chunks in a row, and the offsets of each chunk's."""
        odd: list[int] = []
        if UNSURE.search("".join(chunks)) or "<|" in "\n".join(chunks):
            odd = [i for i, c in enumerate(chunks) if UNSURE.search(c) or "<|" in c]
            at = set(odd)
            plain = ["" if i in at else c for i, c in enumerate(chunks)]
        else:
            plain = chunks
        parts = self.SPLIT.findall("\n".join(plain).lower())
        ids = np.array(self.table.encode_ordinary("\0".join(parts) + "\0") if parts else [], np.uint32)
        lines = ids == self.line
        offsets = np.concatenate([[0], np.flatnonzero(lines) - np.arange(len(chunks) - 1), [len(ids) - max(0, len(chunks) - 1)]]).astype(np.int64)
        ids = ids[~lines]
        if odd:
            encoded = library(self.path).encode_batch_fast([chunks[i] for i in odd], add_special_tokens=False)
            each = np.split(ids, offsets[1:-1])
            for i, e in zip(odd, encoded, strict=True):
                each[i] = np.array(e.ids, np.uint32)
            ids, offsets = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, offsets


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
