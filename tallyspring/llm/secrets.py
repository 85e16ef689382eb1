"""Secret scans with trigram queries.

Each rule's regular expression gives a Boolean query over trigrams that any match must hold (an OR of ANDs over
its mandatory literals, in lower case). For each block of texts an inverted index of just the trigrams in the
queries is built: a posting bitmap for each trigram. Postings are intersected and joined as the query says, and
only the candidates are matched. A rule without mandatory trigrams is matched on all texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyspring.llm.words import row_slices, whole_rows


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # characters of the group; a shorter match is dropped


#: The base rules, in the order in which their kinds are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What stands between the lines of a key: blanks, escaped line ends, quotes and marks of code or quotations.
GAP = r"""(?:[\s"'>,;#*|+]|\\+[nrt])*+"""
#: A private key: its header with all up to the END line of the same label, but never past another header; where END is
#: missing, with the base64 that follows, of which a last line may be short.
KEY = (
    r"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----"
    rf"|(?:{GAP}(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*)*(?:{GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}})*"
    r"""(?:(?:\r?\n|(?:\\+r)?\\+n)[\x20\t>]*[A-Za-z0-9+/]+={0,2}(?=[\x20\t]*(?:[\r\n\\"']|\Z)))?)"""
)
#: Spans that the method adds: formats of widely used credentials.
MORE = (
    Rule("bearer", r"(?i:authorization)[\"']?\x20*[:=]\x20*[\"']?(?i:bearer)\x20+([A-Za-z0-9._~+/=-]+)", 1, 16),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key", KEY),
    Rule("login", r"[a-z][a-z0-9+.-]{0,20}://[^\s/:@]+:([^\s/@]+)@[A-Za-z0-9.-]+", 1, 6),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
#: How much of a run of literals goes into a query.
RUN = 12

Query = frozenset  # of ANDs, each a frozenset of trigrams; an empty AND holds always


def _trigrams(literal: str) -> frozenset[str]:
    low = literal.lower()
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def trigram_query(pattern: str) -> Query:
    """The OR of ANDs of trigrams that every match of the pattern holds.

    The pattern is walked as a sequence of alternatives of literal strings; any other item ends the running
    literals. Where the alternatives would be many, the literals are cut, which only weakens the query.
    """

    def walk(items, state: set[tuple[frozenset[str], str]]) -> set[tuple[frozenset[str], str]]:
        for code, value in items:
            if code is op.LITERAL:
                state = {(done | _trigrams((run + chr(value))[-3:]), (run + chr(value))[-RUN:]) for done, run in state}
            elif code is op.SUBPATTERN:
                state = walk(value[3], state)
            elif code is op.BRANCH:
                state = {x for branch in value[1] for x in walk(branch, state)}
            elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] <= 1:
                low, high, inner = value
                state = ({*state} if low == 0 else set()) | walk(inner, state)
            elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
                state = {(done, "") for done, _ in walk(value[2], state)}
            elif code is op.IN and all(c is op.LITERAL for c, _ in value) and len(value) <= 8:
                state = {y for c in value for y in walk([c], state)}
            elif code is op.AT:
                continue
            else:
                state = {(done, "") for done, _ in state}
            if len(state) > 64:
                state = {(done, "") for done, _ in state}
        return state

    ands = {done for done, _ in walk(_parser.parse(pattern), {(frozenset(), "")})}
    return frozenset(a for a in ands if not any(b < a for b in ands))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = []
        for r in rules:
            # runs of one class that must have a length are searched as such, which finds the same spans
            pattern = re.sub(r"^(.*\])\+$", rf"\1{{{r.least - len(re.match('[A-Z]*', r.pattern)[0])},}}", r.pattern) if not r.group and r.least else r.pattern
            query = trigram_query(r.pattern)
            self.rules.append((r, re.compile(pattern, re.ASCII), None if frozenset() in query else query))
        self.trigrams = sorted({t for _, _, q in self.rules for a in q or () for t in a})

    def candidates(self, texts: list[str]) -> list[np.ndarray | None]:
        """For each rule the numbers of the texts to match; None is all."""
        lowered = [t.lower() for t in texts]
        postings = {g: np.fromiter((g in t for t in lowered), bool, len(texts)) for g in self.trigrams}
        out: list[np.ndarray | None] = []
        for _, _, query in self.rules:
            if query is None:
                out.append(None)
                continue
            any_of = np.zeros(len(texts), bool)
            for ands in query:
                any_of |= np.logical_and.reduce([postings[g] for g in ands])
            out.append(np.flatnonzero(any_of))
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule's number, end) of each text, sorted; leftmost and non-overlapping for each rule."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, ((rule, pattern, _), those) in enumerate(zip(self.rules, self.candidates(texts), strict=True)):
            for i in range(len(texts)) if those is None else those.tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in found]


def redacted(text: str, spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """The text with its spans replaced by their kind in brackets; what overlaps is one replacement."""
    out, at = [], 0
    for start, k, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kinds[k]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def scan(df: DataFrame, *, text_col: str = "text", base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, redact: bool = False) -> DataFrame:
    """One row per input row: row (the input row, a struct), n_<kind> of each base rule, base_sha256, spans, and
    redacted (the text without its secrets) if asked for.

    ``spans`` lists kind:start:end of all rules by start, then by the rules' order, comma-joined, in code points with
    the end exclusive; ``base_sha256`` is the digest of the base rules' list. Null and empty texts have no spans; a null
    text is redacted to an empty one. Ids may be null or repeat, columns may have any name; each text is scanned whole.
    """
    rules = (*base, *more)
    rows = whole_rows(df)
    counts = [f"n_{r.kind}" for r in base]
    strings = ["base_sha256", "spans", *["redacted"] * redact]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in counts), *(T.StructField(c, T.StringType()) for c in strings)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kinds = [r.kind for r in rules]
        for part in row_slices(batches, text_col):
            texts = part.column(1).to_pylist()
            spans = scanner.spans(texts)
            of_base = [[s for s in x if s[1] < len(base)] for x in spans]
            told = lambda x: ",".join([f"{kinds[k]}:{a}:{b}" for a, k, b in x])
            columns = [part.column(0), *(pa.array([sum(s[1] == k for s in x) for x in of_base], pa.int64()) for k in range(len(base)))]
            columns += [pa.array([hashlib.sha256(told(x).encode()).hexdigest() for x in of_base], pa.string()), pa.array([told(x) for x in spans], pa.string())]
            if redact:
                columns.append(pa.array([redacted(t, x, kinds) for t, x in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["row", *counts, *strings])

    return rows.mapInArrow(run, schema)
