"""Missing sequences, ranges of them, and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids of a bucket, in which islands are found before buckets are put together.
BUCKET = 64_000


def bounds(df: DataFrame, column: str) -> DataFrame:
    """Least and greatest value, 0 for an empty table."""
    return df.agg(F.coalesce(F.min(column), F.lit(0)).alias("min_seq"), F.coalesce(F.max(column), F.lit(0)).alias("max_seq"))


def missing(df: DataFrame, column: str, start: int, end: int, limit: int | None = 500) -> DataFrame:
    """Sequences from start to end that the table lacks, in order; at most ``limit``, or all."""
    spark = df.sparkSession
    if end < start or (limit is not None and limit <= 0):
        return spark.range(0).withColumnRenamed("id", column)
    present = df.filter(F.col(column).between(start, end)).select(column)
    absent = spark.range(start, end + 1).withColumnRenamed("id", column).join(present, column, "left_anti").orderBy(column)
    return absent if limit is None else absent.limit(limit)


def contiguous_ranges(ids: DataFrame, column: str, bucket: int = BUCKET) -> DataFrame:
    """Minimal (range_start, range_end) of distinct ids.

    Islands are found inside buckets of ids, over all tasks. Only an island that touches its bucket's edge can go on in
    the next bucket, so at most two of a bucket meet in the second, unpartitioned pass: as many rows as there are
    buckets, not islands.
    """
    inside = Window.partitionBy("_bucket").orderBy(column)
    numbered = ids.select(column).distinct().withColumn("_bucket", F.floor(F.col(column) / bucket)).withColumn("_island", F.col(column) - F.row_number().over(inside))
    parts = numbered.groupBy("_bucket", "_island").agg(F.min(column).alias("s"), F.max(column).alias("e"))
    return merged(parts, bucket)


def merged(parts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Disjoint (s, e), none across a bucket's edge unless it ends at edges, with those that follow on each other put together."""
    at_edge = (F.pmod("s", F.lit(bucket)) == 0) | (F.pmod("e", F.lit(bucket)) == bucket - 1)
    across = Window.orderBy("s")
    joined = parts.filter(at_edge).withColumn("_new", F.coalesce((F.col("s") != F.lag("e").over(across) + 1).cast("int"), F.lit(1))).withColumn("_range", F.sum("_new").over(across))
    whole = joined.groupBy("_range").agg(F.min("s").alias("range_start"), F.max("e").alias("range_end")).drop("_range")
    return parts.filter(~at_edge).select(F.col("s").alias("range_start"), F.col("e").alias("range_end")).union(whole)


#: Ids of a bitmap, as Spark's bitmap functions have them.
BITS = 32_768


def presence(ids: DataFrame, column: str) -> DataFrame:
    """(bucket, bits): a bitmap of the ids in each bucket of 32,768. Buckets are counted from 0, and bit 0 is the bucket's first id."""
    at = F.col(column) + 1
    return ids.groupBy((F.bitmap_bucket_number(at) - 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def absent_ranges(bitmaps: DataFrame, low: int, high: int) -> DataFrame:
    """Minimal (range_start, range_end) from low to high that bitmaps don't have. Several of a bucket are put together.

    Only buckets that are neither full nor empty are looked into, by the byte; a gap over whole buckets is one row however
    long it is. What meets in an unpartitioned window is a row or two a bucket that is there.
    """
    mine = bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).filter(F.col("bucket").between(low // BITS, high // BITS))
    loose = mine.filter(F.bitmap_count("bits") < BITS)
    each = loose.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(BITS // 8 - 1))).alias("at"))
    octet = F.conv(F.hex(F.substring(F.col("bits"), F.col("at") + 1, F.lit(1))), 16, 10).cast("int")
    holes = each.withColumn("octet", F.coalesce(octet, F.lit(0))).filter("octet < 255").select("bucket", "at", "octet", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    ids = holes.filter(F.expr("(octet >> bit) & 1 = 0")).select((F.col("bucket") * BITS + F.col("at") * 8 + F.col("bit")).alias("id")).filter(F.col("id").between(low, high))
    inside = contiguous_ranges(ids, "id", BITS).select(F.col("range_start").alias("s"), F.col("range_end").alias("e"))
    order = Window.orderBy("bucket")
    ends = mine.select("bucket").unionByName(mine.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(F.lit(low // BITS - 1), F.lit(high // BITS + 1))).alias("bucket")))
    skipped = ends.withColumn("next", F.lead("bucket").over(order)).filter("next > bucket + 1").select(((F.col("bucket") + 1) * BITS).alias("s"), (F.col("next") * BITS - 1).alias("e"))
    skipped = skipped.select(F.greatest("s", F.lit(low)).alias("s"), F.least("e", F.lit(high)).alias("e"))
    # a clipped end isn't an edge, but nothing follows on it either
    return merged(inside.union(skipped), BITS)


def first_ids(ranges: DataFrame, most: int) -> DataFrame:
    """The first ranges that hold ``most`` ids, the last one cut."""
    few = ranges.orderBy("range_start").limit(most)
    before = F.sum(F.col("range_end") - F.col("range_start") + 1).over(Window.orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1))
    told = few.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < most)
    return told.select("range_start", F.least("range_end", F.col("range_start") + (most - 1) - F.col("_before")).alias("range_end"))


def rows_in_ranges(landing: DataFrame, ranges: DataFrame, column: str = "sequence", bucket: int = BUCKET) -> DataFrame:
    """Landing rows with an id in one of the ranges.

    A range is cut at buckets. Buckets that it covers whole are joined by their number, so their ids are never spelled
    out; of others, at most two for each range, the ids are, a bucket at most in a row.
    """
    start, end = F.greatest("range_start", F.col("b") * bucket), F.least("range_end", F.col("b") * bucket + bucket - 1)
    cut = ranges.select("range_start", "range_end", F.explode(F.sequence(F.floor(F.col("range_start") / bucket), F.floor(F.col("range_end") / bucket))).alias("b")).select("b", start.alias("s"), end.alias("e"))
    covered = F.col("e") - F.col("s") == bucket - 1
    whole = cut.filter(covered).select(F.col("b").alias("_whole")).distinct()
    ids = cut.filter(~covered).select(F.explode(F.sequence("s", "e")).alias("_id")).distinct()
    joined = landing.join(whole, F.floor(F.col(column) / bucket) == F.col("_whole"), "left").join(ids, F.col(column) == F.col("_id"), "left")
    return joined.filter(F.col("_whole").isNotNull() | F.col("_id").isNotNull()).select(*landing.columns)
