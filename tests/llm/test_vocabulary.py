"""The proofs behind the fast encoders."""

import random
import re

import public_tokenizers
import pyarrow as pa
import pytest

from tallyspring.llm import vocabulary as V
from tallyspring.llm.token_count import Counter
from tallyspring.llm.words import words

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_every_entry_merges_to_itself(path):
    """By the listed pairs alone; so merging by rank of the joined bytes gives what the library gives."""
    model = V.model(path)["model"]
    pairs = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
    suffix = model["end_of_word_suffix"] or ""
    failed = []
    for token in model["vocab"]:
        if suffix and token.endswith(suffix) and token != suffix:
            parts = [*token[: -len(suffix)][:-1], token[: -len(suffix)][-1] + suffix]
        else:
            parts = list(token)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: pairs.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in pairs:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if parts != [token]:
            failed.append(token)
    assert not failed


def test_characters_taken_as_sure_are_split_alike():
    sure = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not V.UNSURE.match(chr(c)) and not chr(c).isspace()]
    assert len(sure) > 20_000
    own = re.compile(V.WordEncoder.SPLIT.pattern)
    library = V.library(WORDS)
    for at in range(0, len(sure), 500):
        text = " ".join(f"{c} a{c}b 1{c}" for c in sure[at : at + 500])
        expected = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        found = [m.span() for m in own.finditer(text.lower())]
        assert [b - a for a, b in found] == [b - a for _, (a, b) in expected]


ODD = ["", " a  b\n\n c ", "<|endoftext|> x <|endoftext|>", "foo <|endoftext|>bar", "日本語 テキスト", "a\xa0b \u2003c", "it's we'll I'D", " x", "x ", "\n", "naïve — “q” … ‘s", "e\u0301 x", "\x1c a \x85b", "١٢٣ ²x ½", "a\t b \tc", "a_b 12 3a", "A<|ENDOFTEXT|>", "Σίσυφος ΟΔΟΣ", "İx ſx", "don't", "🎈 \x00 a\x00b"]


def random_texts(n: int) -> list[str]:
    rng = random.Random(3)
    alphabet = "aeiouthrsn   \n,.'-_0129ÉßñÀ日語…“"
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 300))) for _ in range(n)]


def test_counts_equal_the_library():
    texts = ODD + random_texts(300) + ["x" * 50_000, "a b " * 20_000]
    counted = Counter(BYTES, V.whole_tokens(BYTES)).texts(pa.array(texts, pa.large_string()))
    assert counted.tolist() == [len(V.library(BYTES).encode(t, add_special_tokens=False).ids) for t in texts]


def test_word_ids_equal_the_library():
    encoder = V.WordEncoder(WORDS)
    for text in ODD + random_texts(300):
        _, codes, distinct = words(pa.array([text], pa.large_string()))
        ids, cuts = encoder.encode(distinct) if distinct else ([], [0])
        got = [int(x) for c in codes for x in ids[cuts[c] : cuts[c + 1]]]
        assert got == V.library(WORDS).encode(text, add_special_tokens=False).ids, text
