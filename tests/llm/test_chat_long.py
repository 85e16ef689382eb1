"""Conversations of very many turns, whose spans and digests are worked out in near-linear time."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from tallyspring.llm.chat import digests, format_conversations, loss_text, running_totals


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_running_totals(spark, n):
    numbers = [(7 * i) % 11 for i in range(n)]
    found = spark.createDataFrame([(numbers,)], "x array<int>").select(running_totals(F.col("x"))).first()[0]
    assert found == [sum(numbers[: i + 1]) for i in range(n)]


@pytest.mark.parametrize("spans", [[(0, 3)], [(1020, 1030)], [(0, 1024), (1024, 2048)], [(5, 4000)], [(1023, 1024), (2047, 2049), (4095, 4096)], [(10, 10)], []])
def test_spans_are_cut_from_pieces(spark, spans):
    text = "".join(chr(0x61 + i % 26) if i % 7 else "\U0001f600" for i in range(4096))
    df = spark.createDataFrame([(text, spans)], "formatted string, spans array<struct<start:int,end:int>>")
    assert df.select(loss_text(F.col("formatted"), F.col("spans"))).first()[0] == "".join(text[a:b] for a, b in spans)


def test_a_hundred_thousand_turns(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text < "), "id").alias("text"))
    start = time.perf_counter()
    told = digests(format_conversations(rows)).first()
    took = time.perf_counter() - start
    turns = [("user" if i % 3 == 0 else "assistant", f"text < {i}") for i in range(n)]
    loss = "".join(t for r, t in turns if r == "assistant")
    assert told["n_turns"] == n and told["loss_chars"] == len(loss)
    assert told["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert told["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert took < 60  # growth with the square of the turns would take minutes
