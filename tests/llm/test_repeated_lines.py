"""Near copies under equal weights that TF-IDF weights alone would set apart."""

import random

from tallyspring.llm.minhash import near_duplicates


def test_pairs_that_differ_in_repeats_of_a_line(spark):
    rng, rows = random.Random(3), []
    for k in range(20):
        own, line = (" ".join(f"w{rng.randrange(10**9)}" for _ in range(40)) for _ in range(2))
        # the same shingles, half of them from the line
        rows += [(2 * k, f"{own} {line} {line}"), (2 * k + 1, f"{own} {' '.join([line] * 100)}")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {i: i - i % 2 for i, _ in rows}
