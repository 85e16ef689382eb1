"""Mixing of sources to target weights by weighted fair queueing.

The documents of a source stand in a shuffled queue that repeats after its end; long ones are served in packets. A
packet's virtual finish time is the size of its source's queue up to and with it, divided by the source's target; the
mix takes packets in the order of finish times, over all sources, until its budget is spent. Nothing else decides what
is taken: a source comes near its target because its packets up to there finish before time 1.

Prefix sums of a queue run in two steps, over hash buckets whose number follows the source's rows, so a source
with a third of all rows is spread over as many tasks as any other rows. Only ids, sources and sizes move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspring.llm.storage import cut

#: Documents of a bucket on average, and the most buckets of a source or slots of the global order.
BUCKET_ROWS = 2000
MOST_BUCKETS = 65536
#: Sources up to which their statistics are sent to all tasks; more are joined by shuffle.
BROADCAST_SOURCES = 2000
#: Words of a packet at most: how near a source comes to its target.
PACKET = 128


def word_count(text: Column) -> Column:
    """Number of runs of characters outside [\\x20\\x09-\\x0D]; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, *, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds weight and target to (source, source_size, n_rows).

    The sources by code point, null last, weigh ``weights`` in turn. They share ``share`` of all sizes by weight;
    a target stops at ``most`` times its source's size and the excess goes to the others, by weight. Sorted by
    cap / weight, the capped sources come first, so the level of the rest follows from running sums.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    ranked = sources.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("total", total).withColumn("level", level)
    # the first source that its cap doesn't stop sets the level for all behind it
    free = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())
    return ranked.withColumn("free", free["level"]).select("source", "source_size", "n_rows", "weight", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("free") * F.col("weight"))).alias("target"))


def mix(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, first_at, again_at.

    ``taken`` counts the words that the mix takes of the row, repeats included: at most ``most`` times its size.
    The document at which the budget ends a source's part is taken in part. ``first_at`` and ``again_at`` are the places, in
    words, of the document's first and second copy in the mix; null where it isn't taken. Rows of size 0 are never
    taken. Null is a source like others. Ids may be null or repeat; rows that are equal in id, source and size get
    places in no set order, so reruns agree as sets of rows. An empty table gives an empty result.
    """
    # rows without an id, or with one id, still are spread by their texts
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.md5(F.col(text_col)), F.lit(""))))
    h = F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("h")
    slim = cut(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), h))
    stats = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    stats = cut(targets(stats, weights=weights, share=share, most=most))
    buckets = F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("n_rows") / BUCKET_ROWS)).cast("long")
    stats = stats.select(F.col("source").alias("s2"), "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("due"), buckets.alias("buckets"))
    n_sources, slots, budget = stats.agg(F.count("*"), F.sum("buckets"), F.sum("due")).first()
    slots, budget = min(MOST_BUCKETS, 2 * (slots or 1)), budget or 0
    stats = F.broadcast(stats) if n_sources <= BROADCAST_SOURCES else stats
    queued = slim.join(stats, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    queued = queued.withColumn("bucket", F.pmod(F.col("h"), F.col("buckets")))

    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = queued.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = sums.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    placed = queued.withColumn("n", F.row_number().over(inside)).withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    placed = cut(placed.select("doc_id", "source", "size", "source_size", "target", "bucket", "n", (F.col("ahead") + F.col("inside")).alias("start")))

    queue_end = F.floor(F.col("source_size") * F.lit(float(most))).cast("long")
    copies = placed.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)))).filter("size > 0")
    copies = copies.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PACKET).cast("long"))))
    copies = copies.withColumn("begin", F.col("round") * F.col("source_size") + F.col("start") + F.col("piece"))
    copies = copies.withColumn("part", F.least(F.lit(PACKET).cast("long"), F.col("size") - F.col("piece"), queue_end - F.col("begin"))).filter("part > 0")
    copies = copies.withColumn("finish", F.try_divide((F.col("begin") + F.col("part")).cast("double"), F.col("target"))).filter("finish IS NOT NULL")
    # the budget is spent at about time 1, so nothing after time 2 needs an order
    copies = copies.select("source", "bucket", "n", "round", "piece", "part", "finish").withColumn("slot", F.floor(F.least("finish", F.lit(2.0)) * slots))
    by_slot = copies.groupBy("slot").agg(F.sum("part").alias("slot_size"))
    by_slot = by_slot.select(F.col("slot").alias("slot2"), F.coalesce(F.sum("slot_size").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("slot_ahead"))
    by_slot = cut(by_slot.filter(F.col("slot_ahead") < budget))
    live = copies.join(F.broadcast(by_slot), F.col("slot") == F.col("slot2"))
    in_slot = Window.partitionBy("slot").orderBy("finish", "source", "bucket", "n", "round", "piece").rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = live.withColumn("at", F.col("slot_ahead") + F.sum("part").over(in_slot) - F.col("part"))
    sorted_ = sorted_.withColumn("part", F.least(F.col("part"), F.lit(budget) - F.col("at"))).filter("part > 0")
    mixed = sorted_.groupBy(F.col("source").alias("s2"), F.col("bucket").alias("b2"), F.col("n").alias("n2")).agg(
        F.sum("part").alias("taken"), F.min(F.when(F.col("round") == 0, F.col("at"))).alias("first_at"), F.min(F.when(F.col("round") > 0, F.col("at"))).alias("again_at")
    )
    out = placed.join(mixed, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")) & (F.col("n") == F.col("n2")), "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_at", "again_at")
