"""Language ID of whole tables against a plain version: dictionaries of trigrams and the recursion over every text."""

import collections
import math

import pytest

from tallyspring.llm import langid

SF = "/root/testdata/sf0.001"
WIDE = ("Han", "Kana", "Thai")


def script(ch):
    return [name for first, name in langid.SCRIPTS.items() if first <= ord(ch)][-1]


def plain_pieces(word):
    """(code points before it, letters) of the pieces of a word."""
    out = []
    for i, ch in enumerate(word):
        if ch.isalpha():
            own = script(ch)
            if not out or own != script(out[-1][1][-1]) or len(out[-1][1]) == (4 if own in WIDE else 64):
                out.append((i, ""))
            out[-1] = (out[-1][0], out[-1][1] + ch)
    return out


def trigrams(piece):
    w = f" {''.join(ch.lower() for ch in piece)} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def plain_words(text):
    return "".join(" " if ch in "\t\n\v\f\r" else ch for ch in text or "").split(" ")


class Plain:
    def __init__(self, rows):
        self.n = collections.defaultdict(collections.Counter)
        self.scripts = collections.defaultdict(collections.Counter)
        for lang, text in rows:
            for word in plain_words(text):
                for _, piece in plain_pieces(word):
                    self.n[lang].update(trigrams(piece))
                    self.scripts[lang][script(piece[0])] += len(piece)
        self.langs = sorted(self.n)
        kinds = len(set().union(*self.n.values()))
        self.total = {x: sum(self.n[x].values()) for x in self.langs}
        self.below = {x: self.total[x] + 0.5 * (kinds + 1) for x in self.langs}

    def scores(self, piece):
        own = [x for x in self.langs if (n := self.scripts[x][script(piece[0])]) and n * 100 >= self.total[x]]
        if not own:
            return None
        s = {x: sum(math.log((self.n[x][g] + 0.5) / self.below[x]) for g in trigrams(piece)) for x in own}
        return [s.get(x, min(s.values()) - 12.0) for x in self.langs]

    def label(self, text):
        """Language and score, or None where two paths are as good."""
        steps, letters = [], []
        for word in plain_words(text):
            for _, piece in plain_pieces(word):
                s = self.scores(piece)
                steps.append(s or [0.0] * len(self.langs)), letters.append(len(piece) if s else 0)
        if not steps:
            return "und", 0.0
        if not sum(letters):
            return None
        best, back = steps[0], []
        for s in steps[1:]:
            top = max(range(len(best)), key=best.__getitem__)
            back.append([k if best[k] >= best[top] - 12.0 else top for k in range(len(best))])
            best = [max(b, best[top] - 12.0) + x for b, x in zip(best, s, strict=True)]
        path = [max(range(len(best)), key=best.__getitem__)]
        for b in reversed(back):
            path.append(b[path[-1]])
        by = collections.Counter()
        for k, n in zip(reversed(path), letters, strict=True):
            by[self.langs[k]] += n
        (lang, n), *_ = sorted(by.items(), key=lambda x: (-x[1], x[0]))
        return lang, n / sum(letters)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


def test_whole_table_against_the_plain_version(spark, docs):
    rows = docs.collect()
    plain = Plain([(r["lang"], r["text"]) for r in rows if r["lang"] and r["text"]])
    texts = [r["text"] for r in rows] + [None, "", "  12 ", " ".join(f"{a['text'][:90]} {b['text'][:70]}" for a, b in zip(rows[:40], rows[40:80], strict=True) if a["text"] and b["text"])]
    model = langid.train(docs, id_col="doc_id", text_col="text", lang_col="lang")
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    mixed = 0
    for r in langid.identify(given, model).select("row.*", "lang_pred", "score", "spans").collect():
        lang, score = plain.label(r["text"])
        assert (r["lang_pred"], round(r["score"], 9)) == (lang, round(score, 9)), r["doc_id"]
        mixed += 0 < score < 1
    assert mixed


@pytest.fixture(scope="module")
def many(spark):
    words = {"en": "the house and the garden are old", "fr": "la maison et le jardin sont vieux", "ru": "дом и сад очень старые", "zh": "这个房子和花园都很老了我们走吧", "ja": "このいえとにわはとてもふるいです", "th": "บานและสวนเกามาก"}
    rows = [(i, text, lang) for i, (lang, text) in enumerate(words.items())]
    return words, langid.train(spark.createDataFrame(rows, "doc_id int, text string, lang string"), id_col="doc_id", text_col="text", lang_col="lang")


def spans(spark, model, text):
    return langid.identify(spark.createDataFrame([(text,)], "text string"), model).first()["spans"]


def test_spans_inside_text_without_blanks(spark, many):
    words, model = many
    zh, ja, th = words["zh"], words["ja"], words["th"]
    assert spans(spark, model, f"{zh}{ja}") == f"0-0.{len(zh)}:zh 0.{len(zh)}-1:ja"
    assert spans(spark, model, f"дом и сад:{th}") == "0-2.4:ru 2.4-3:th"
    assert spans(spark, model, f"the house and the garden{zh} ") == "0-4.6:en 4.6-5:zh"


def test_pieces_are_the_plain_ones():
    words = ["don't", "hello你好吗朋友们", "a" * 200, "ÀÉİß", "--", "x1日本2", "ｆｕｌｌ", "ไทยภาษา", "\U0002a6d6\U0002a6d6", "ǅ’ª", "𝒳y"]
    p = langid.pieces(words)
    for i, w in enumerate(words):
        want = plain_pieces(w)
        own = slice(p.first[i], p.first[i] + p.count[i])
        assert list(zip(p.char[own].tolist(), p.letters[own].tolist(), strict=True)) == [(a, len(x)) for a, x in want if ord(x[0]) < langid.TOP]
    assert p.letters.sum() == len(p.grams)
    assert langid.pieces([]).count.tolist() == []


def test_texts_take_the_recursion_together_as_alone():
    import numpy as np

    rng = np.random.default_rng(3)
    n = rng.integers(1, 30, 200)
    offsets = np.concatenate([[0], np.cumsum(n)])
    s = rng.normal(0, 4, (offsets[-1], 5))
    together = langid.viterbi(s, 3.0, offsets)
    for a, b in zip(offsets, offsets[1:], strict=False):
        assert together[a:b].tolist() == langid.viterbi(s[a:b], 3.0).tolist()


def test_one_unbroken_text_of_megabytes(spark, many):
    _, model = many
    text = "house的" * 700_000
    assert langid.identify(spark.createDataFrame([(text,)], "text string"), model).first()["lang_pred"] == "en"
