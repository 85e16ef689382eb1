"""Language identification: script ranges, per-word scores and a Viterbi path with a switching penalty.

The model is learned with Spark from labelled documents: counts of the character trigrams of pieces of words, and the
scripts in which a language is written. It is learned from a sample of bounded size, so it is collected and sent to the
tasks. A word is cut where its script changes, and text in scripts without blanks every few letters, so that a span can
begin inside a word. A piece is scored only for the languages of its script. The Viterbi path over a text's pieces gives
spans of languages; the text's language is the one with most letters on the path.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspring.llm.words import SLICE_BYTES, row_slices, row_sums, slices, whole_rows, words

#: The bound of the model: labelled documents of a language, on average, drawn by hash of the id. All their trigrams are
#: kept, and all languages.
SAMPLE_DOCS = 4000
#: What a switch of language costs on the path, in natural-log units.
SWITCH = 12.0
#: Letters of a piece at most, in scripts written with blanks and in those without.
PIECE, UNSPACED_PIECE = 64, 4
UNDETERMINED = "und"

#: First code points of script ranges (Unicode blocks), up to the next entry.
SCRIPTS = {
    0x0000: "Latin", 0x0370: "Greek", 0x0400: "Cyrillic", 0x0530: "Armenian", 0x0590: "Hebrew", 0x0600: "Arabic",
    0x0700: "Syriac", 0x0750: "Arabic", 0x0780: "Thaana", 0x07C0: "Nko", 0x0800: "Samaritan", 0x0840: "Mandaic", 0x0860: "Syriac",
    0x0870: "Arabic", 0x0900: "Devanagari", 0x0980: "Bengali", 0x0A00: "Gurmukhi", 0x0A80: "Gujarati", 0x0B00: "Oriya",
    0x0B80: "Tamil", 0x0C00: "Telugu", 0x0C80: "Kannada", 0x0D00: "Malayalam", 0x0D80: "Sinhala", 0x0E00: "Thai",
    0x0E80: "Lao", 0x0F00: "Tibetan", 0x1000: "Myanmar", 0x10A0: "Georgian", 0x1100: "Hangul", 0x1200: "Ethiopic",
    0x13A0: "Cherokee", 0x1400: "Syllabics", 0x1680: "Other", 0x1780: "Khmer", 0x1800: "Mongolian", 0x18B0: "Syllabics",
    0x1900: "Other", 0x19E0: "Khmer", 0x1A00: "Other", 0x1C80: "Cyrillic", 0x1C90: "Georgian", 0x1CC0: "Other", 0x1D00: "Latin",
    0x1F00: "Greek", 0x2000: "Other", 0x2C60: "Latin", 0x2C80: "Greek", 0x2D00: "Georgian", 0x2D30: "Tifinagh", 0x2D80: "Ethiopic",
    0x2DE0: "Cyrillic", 0x2E80: "Han", 0x3040: "Kana", 0x3100: "Bopomofo", 0x3130: "Hangul", 0x3190: "Han", 0x31F0: "Kana",
    0x3200: "Other", 0x3400: "Han", 0xA000: "Yi", 0xA4D0: "Other", 0xA640: "Cyrillic", 0xA6A0: "Other", 0xA720: "Latin",
    0xA800: "Other", 0xA960: "Hangul", 0xA980: "Other", 0xAA60: "Myanmar", 0xAA80: "Other", 0xAB00: "Ethiopic", 0xAB30: "Latin",
    0xAB70: "Cherokee", 0xABC0: "Other", 0xAC00: "Hangul", 0xD800: "Other", 0xF900: "Han", 0xFB00: "Latin", 0xFB13: "Armenian",
    0xFB1D: "Hebrew", 0xFB50: "Arabic", 0xFE00: "Other", 0xFE70: "Arabic", 0xFF00: "Latin", 0xFF66: "Kana", 0xFFA0: "Hangul",
    0xFFE0: "Other", 0x20000: "Han", 0x323B0: "Other",
}
#: Scripts written without blanks between words.
UNSPACED = ("Han", "Kana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")
NAMES = ["", *dict.fromkeys(SCRIPTS.values())]
#: The first code point above all letters; one takes 18 bits.
TOP = max(SCRIPTS)


@functools.cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point up to ``TOP``: the lower case if it is one character, and the script of a letter as its place in
    ``NAMES``; 0 is no letter."""
    letter = [chr(i).isalpha() for i in range(TOP)] + [False]
    lower = [ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(TOP)] + [TOP]
    starts, names = np.array(list(SCRIPTS)), np.array([NAMES.index(x) for x in SCRIPTS.values()])
    script = names[np.searchsorted(starts, np.arange(TOP + 1), "right") - 1]
    return np.array(lower, np.int64), np.where(letter, script, 0)


@dataclass
class Pieces:
    """Runs of letters of one script in distinct words, in order."""

    #: by word: its first piece and their number
    first: np.ndarray
    count: np.ndarray
    #: by piece: code points of the word before it, script, letters
    char: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    #: by letter: the trigram around it, with its script; a piece has as many trigrams as letters
    grams: np.ndarray


def pieces(distinct: list[str]) -> Pieces:
    """The pieces of words. What isn't a letter is left out, and doesn't part letters; a word without letters has none.

    A trigram is three letters of 18 bits under the script; a blank stands for what is before and after a piece.
    """
    lower, script_of = characters()
    points = np.minimum(np.frombuffer(" ".join(distinct).encode("utf-32-le"), "<u4"), TOP)
    blank = points == 32
    at = np.flatnonzero(script_of[points])
    word = np.cumsum(blank, dtype=np.int32)[at]
    script, c = script_of[points[at]], lower[points[at]]
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(word) != 0) | (np.diff(script) != 0)
    run = np.flatnonzero(first)
    place = np.arange(len(at)) - np.repeat(run, np.diff([*run, len(at)]))
    unspaced = np.isin(np.arange(len(NAMES)), [NAMES.index(x) for x in UNSPACED])
    first |= place % np.where(unspaced, UNSPACED_PIECE, PIECE)[script] == 0
    last = np.append(first[1:], True)[: len(at)]
    grams = script << 54 | np.where(first, 32, np.roll(c, 1)) << 36 | c << 18 | np.where(last, 32, np.roll(c, -1))
    starts = np.flatnonzero(first)
    begins = np.concatenate([[0], np.flatnonzero(blank) + 1])
    count = np.bincount(word[starts], minlength=len(distinct))
    return Pieces(np.cumsum(count) - count, count, at[starts] - begins[word[starts]], script[starts], np.diff([*starts, len(at)]), grams)


@dataclass
class Model:
    languages: list[str]
    commonest: int = 0
    #: trigrams in order, and their log probability by language; the last one is for any other
    grams: np.ndarray | None = None
    log_p: np.ndarray | None = None
    #: languages by script, as masks
    of_script: dict[int, np.ndarray] = field(default_factory=dict)

    def scores(self, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces: log scores by language, and letters that languages can claim.

        Only the languages of a piece's script are candidates: any other gets the worst candidate's score less a
        switch. A piece in a script of no language says nothing.
        """
        out, letters = np.zeros((len(p.script), len(self.languages))), np.zeros(len(p.script))
        for name in np.unique(p.script).tolist():
            if (mask := self.of_script.get(name)) is None:
                continue
            own = p.script == name
            lengths = p.letters[own]
            letters[own] = lengths
            grams = p.grams if own.all() else p.grams[np.repeat(own, p.letters)]
            row = np.searchsorted(self.grams, grams)
            row[self.grams[np.minimum(row, len(self.grams) - 1)] != grams] = len(self.grams)
            found = np.empty((len(lengths), len(self.languages)))
            for k in np.flatnonzero(mask):
                found[:, k] = np.add.reduceat(self.log_p[k][row], np.cumsum(lengths) - lengths)
            found[:, ~mask] = found[:, mask].min(1, keepdims=True) - SWITCH
            out[own] = found
        return out, letters


def viterbi(scores: np.ndarray, switch: float, offsets: np.ndarray | None = None) -> np.ndarray:
    """The best language of each piece, each change of language inside a text costing ``switch``.

    ``offsets`` are the bounds of texts, none of them empty; without them all is one text. The recursion takes a step
    in all texts that are long enough at once.
    """
    offsets = np.array([0, len(scores)]) if offsets is None else offsets
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    # texts longer than t
    longer = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
    back = np.empty(scores.shape, np.int32)
    best = scores[starts]
    stay = np.arange(scores.shape[1])
    for t in range(1, lengths[0]):
        m = longer[t]
        b = best[:m]
        top = b.argmax(1)
        moved = b[np.arange(m), top][:, None] - switch
        keep = b >= moved
        back[starts[:m] + t] = np.where(keep, stay, top[:, None])
        best[:m] = np.where(keep, b, moved) + scores[starts[:m] + t]
    path = np.empty(len(scores), np.int32)
    path[starts + lengths - 1] = best.argmax(1)
    for t in range(lengths[0] - 1, 0, -1):
        at = starts[: longer[t]] + t
        path[at - 1] = back[at, path[at]]
    return path


def one_language(scores: np.ndarray, offsets: np.ndarray, leader: np.ndarray, switch: float) -> np.ndarray:
    """Texts whose Viterbi path surely stays with the leader: no run of words gains more than a switch for any rival,
    nor do a first and a last run together.

    A path that visits the leader has at least one switch for every run away from it, so such runs can't pay. One that
    never does has a switch less than runs: its inner runs pay for themselves at best, and its first and its last run
    share a switch. A single rival can't pay, as the leader has the best sum. The best run ending at each word is a
    difference of prefix sums, for all texts at once.
    """
    lengths = np.diff(offsets)
    gain = scores - scores[np.arange(len(scores)), np.repeat(leader, lengths)][:, None]
    prefix = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(gain, axis=0)])
    sure = np.ones(len(leader), bool)
    for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        if b > a:
            part = prefix[a : b + 1]
            most = (part[1:] - np.minimum.accumulate(part[:-1], axis=0)).max()
            sure[i] = most <= switch
            if switch / 2 < most <= switch:
                first, last = (part[1:].max(0) - part[0]).max(), (part[-1] - part[:-1].min(0)).max()
                sure[i] = first + last <= switch
    return sure


def label(model: Model, texts: pa.Array, switch: float = SWITCH) -> tuple[list[str], list[float], list[str]]:
    """Language, share of its letters, and spans of each text."""
    word_offsets, codes, distinct = words(texts)
    p = pieces(distinct)
    scored, letters = model.scores(p)
    count = p.count[codes]
    ends = np.concatenate([[0], np.cumsum(count)])
    code = np.repeat(p.first[codes] - ends[:-1], count) + np.arange(ends[-1])  # a piece of each place
    offsets = ends[word_offsets]
    s, n = scored[code], letters[code]
    leader = row_sums(s, offsets).argmax(1)
    claimed, lengths = row_sums(n, offsets), np.diff(offsets)
    open_ = ~one_language(s, offsets, leader, switch) & (claimed > 0)
    inside = np.repeat(open_, lengths)
    own = np.concatenate([[0], np.cumsum(lengths[open_])])
    path = viterbi(s[inside], switch, own) if open_.any() else np.empty(0, np.int32)
    taken, at = n[inside], np.flatnonzero(inside)

    def place(x: int, before: int) -> str:
        w = int(np.searchsorted(ends, x, "right")) - 1
        return f"{w - before}" if ends[w] == x else f"{w - before}.{p.char[code[x]]}"

    langs, shares, spans, k = [], [], [], 0
    for i in range(len(lengths)):
        before, n_words = int(word_offsets[i]), int(word_offsets[i + 1] - word_offsets[i])
        if not lengths[i]:
            langs.append(UNDETERMINED), shares.append(0.0), spans.append("")
        elif not claimed[i]:  # letters in scripts of no language only
            langs.append(model.languages[model.commonest]), shares.append(0.0), spans.append("")
        elif not open_[i]:
            langs.append(model.languages[leader[i]]), shares.append(1.0), spans.append(f"0-{n_words}:{model.languages[leader[i]]}")
        else:
            a, b = own[k : k + 2].tolist()
            k += 1
            by = np.bincount(path[a:b], taken[a:b], len(model.languages))
            best = int(by.argmax())
            langs.append(model.languages[best]), shares.append(float(by[best] / claimed[i]))
            cuts = (np.flatnonzero(np.diff(path[a:b])) + 1 + a).tolist()
            bounds = ["0", *(place(int(at[x]), before) for x in cuts), str(n_words)]
            spans.append(" ".join(f"{x}-{y}:{model.languages[path[j]]}" for x, y, j in zip(bounds, bounds[1:], [a, *cuts], strict=False)))
    return langs, shares, spans


def train(df: DataFrame, *, id_col: str, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from labelled rows: all rows with a language and a text, or a sample of ``sample_docs`` a language.

    A row is in the sample if the hash of its id falls under the share that gives its language that many rows.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = dict(rows.groupBy("lang").count().collect())
    if not sizes:
        return Model([])
    share = F.create_map([F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample_docs / n))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], int] = {}
        for part in slices(batches):
            offsets, codes, distinct = words(part.column(0))
            p = pieces(distinct)
            grams, place = np.unique(p.grams, return_inverse=True)
            word = np.repeat(np.repeat(np.arange(len(distinct)), p.count), p.letters)
            row_lang = pa.array(part.column(1)).cast(pa.string()).dictionary_encode()
            word_lang = np.repeat(row_lang.indices.to_numpy(), np.diff(offsets))
            for k, lang in enumerate(row_lang.dictionary.to_pylist()):
                times = np.bincount(codes[word_lang == k], minlength=len(distinct))
                counts = np.bincount(place, times[word], len(grams)).astype(np.int64)
                for i in np.flatnonzero(counts).tolist():
                    key = (lang, int(grams[i]))
                    found[key] = found.get(key, 0) + int(counts[i])
        if found:
            langs, grams = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.int64()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = rows.filter(drawn).select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()  # those of the sample
    model = Model(sorted(sizes))
    model.commonest = model.languages.index(max(sorted(sizes), key=sizes.get))
    if not counted:
        return model
    model.grams, row = np.unique(np.array([r["gram"] for r in counted]), return_inverse=True)
    lang = np.array([model.languages.index(r["lang"]) for r in counted])
    counts = np.zeros((len(model.languages), len(model.grams) + 1))
    counts[lang, row] = [r["n"] for r in counted]
    totals = counts.sum(1, keepdims=True)
    model.log_p = np.log((counts + 0.5) / (totals + 0.5 * counts.shape[1]))
    # a script is a language's if it has a hundredth of its trigrams
    script = model.grams >> 54
    for name in np.unique(script).tolist():
        n = counts[:, :-1][:, script == name].sum(1)
        if (mask := (n * 100 >= totals[:, 0]) & (n > 0)).any():
            model.of_script[name] = mask
    return model


def identify(df: DataFrame, model: Model, *, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """One row per input row: row (the input row, a struct), lang_pred, score, spans.

    ``score`` is the share of letters that the path gives to the language; ``spans`` lists first word, end and language
    of the path's runs. ``3.5`` is inside word 3, after 5 of its code points. A text that is null or has no letter is ``und`` with score 0 and no spans; one with letters in
    scripts of no learned language gets the commonest language with score 0. Without labelled rows all are ``und``.
    Ids may be null or repeat, and columns may have any name.
    """
    rows = whole_rows(df)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        # a piece has a score for each language
        for part in row_slices(batches, text_col, SLICE_BYTES * 8 // max(8, len(m.languages))):
            if m.languages:
                langs, scores, spans = label(m, part.column(1), switch)
            else:
                langs, scores, spans = [UNDETERMINED] * part.num_rows, [0.0] * part.num_rows, [""] * part.num_rows
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], names=["row", "lang_pred", "score", "spans"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.StringType())]))


def held_out(id_: Column) -> Column:
    """Rows that no model learns from."""
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0
