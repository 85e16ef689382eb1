"""Tables as bases and deltas, so that appends, corrections and compaction don't disturb one another.

A table's folder holds

    version=12/kind=row/chunk=2024-01-01/    rows that one commit added
    version=12/kind=delete/chunk=2024-01-01/ keys that it took back from earlier versions
    base=10/run=x/kind=row/chunk=2024-01-01/ all rows of a chunk up to version 10

Versions rise, and count once their job has put its success mark; a base counts once the list of its chunks is there. A
reader takes for each chunk its newest base and the versions after it, and drops rows whose key a later version takes
back. Compaction writes a base of what it has read and nothing else, so what is committed meanwhile stays; a crash at
any point leaves a table that reads the same. Files that a base has replaced are removed by ``vacuum``, after a time
in which readers that know them can end. A table without time partitions has one chunk, named ``all``.
"""

from __future__ import annotations

import functools
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspring.schemas import BLOOMS, BUCKET_KEYS, BUCKETS, CHUNKS, FOLDS, KEYS, SEGMENTS, table_schema

CHUNK, WHOLE = "chunk", "all"
#: Name of the list of chunks that a base is for; its presence ends the base.
CHUNK_LIST = "_chunks"
#: Seconds for which replaced files stay.
GRACE = 3600
#: Bytes of a row group of compacted files, in memory. A look-up reads whole row groups, so they are smaller than Parquet's own 128 MB.
ROW_GROUP = 32 << 20


@functools.cache
def path_class(context: SparkContext):
    """Hadoop's class of paths; to find it takes longer than to use it."""
    return context._jvm.org.apache.hadoop.fs.Path


class Files:
    """Listings through Spark's own file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root, self.path = spark._jvm, root, path_class(spark.sparkContext)
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> dict[str, float]:
        """Names in a folder with their age in seconds; none if there is no such folder."""
        there = self.path(folder)
        if not self.fs.exists(there):
            return {}
        now = time.time()
        return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in self.fs.listStatus(there)}

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def create_new(self, name: str) -> bool:
        """Makes an empty file; false if it is there already."""
        return self.fs.createNewFile(self.path(name))

    def put(self, name: str, text: str) -> None:
        """A small file that is there whole or not at all."""
        out = self.fs.create(self.path(f"{name}.new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.rename(self.path(f"{name}.new"), self.path(name))

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


@dataclass
class Layout:
    """What a reader takes: for each chunk its base (number, folder), and the chunk folders of later versions."""

    newest: int = 0
    bases: dict[str, tuple[int, str]] = field(default_factory=dict)
    rows: dict[str, list[int]] = field(default_factory=dict)
    deletes: dict[str, list[int]] = field(default_factory=dict)


def run_name() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def numbered(names, prefix: str) -> list[int]:
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{prefix}=(\d+)", n)))


def runs_of(files: Files, folder: str) -> list[str]:
    """The runs of a base number in the order of their names, which begin with the time."""
    return sorted(files.names(folder))


def chunks_in(files: Files, folder: str) -> list[str]:
    return [n.removeprefix(f"{CHUNK}=") for n in files.names(folder) if n.startswith(f"{CHUNK}=")]


def layout(spark: SparkSession, folder: str, table: str, upto: int | None = None) -> Layout:
    """The present state of a table, or the one at a version that no base has passed."""
    root = f"{folder}/{table}"
    files, out = Files(spark, root), Layout()
    names = files.names(root)
    covered: dict[str, tuple[int, str | None]] = {}
    for n in numbered(names, "base"):
        for run in runs_of(files, f"{root}/base={n}"):
            at = f"{root}/base={n}/{run}"
            if files.exists(f"{at}/{CHUNK_LIST}"):
                filled = set(chunks_in(files, f"{at}/kind=row"))
                for chunk in json.loads(files.text(f"{at}/{CHUNK_LIST}")):
                    covered[chunk] = (n, at if chunk in filled else None)
    out.bases = {c: (n, at) for c, (n, at) in covered.items() if at}
    out.newest = max([0, *(n for n, _ in covered.values())])
    for v in numbered(names, "version"):
        if (upto is None or v <= upto) and files.exists(f"{root}/version={v}/_SUCCESS"):
            out.newest = max(out.newest, v)
            for kind, into in (("row", out.rows), ("delete", out.deletes)):
                for chunk in chunks_in(files, f"{root}/version={v}/kind={kind}"):
                    if v > covered.get(chunk, (0, None))[0]:
                        into.setdefault(chunk, []).append(v)
    return out


def schema_of(table: str) -> T.StructType:
    return T.StructType([*table_schema(table).fields, T.StructField(CHUNK, T.StringType())])


def read(spark: SparkSession, folder: str, table: str, at: Layout | None = None) -> DataFrame:
    """A table with today's columns and ``chunk``; files written before a column was added give nulls."""
    at = layout(spark, folder, table) if at is None else at
    root, columns = f"{folder}/{table}", [f.name for f in schema_of(table).fields]

    def under(*names: str) -> T.StructType:
        """The files' schema with the columns that folders tell."""
        told = [T.StructField(n, T.LongType() if n in ("version", "base") else T.StringType()) for n in (*names, "kind")]
        return T.StructType([*table_schema(table).fields, *told, T.StructField(CHUNK, T.StringType())])

    parts = []
    if at.bases:
        found = spark.read.schema(under("base", "run")).option("basePath", root).parquet(*(f"{where}/kind=row/{CHUNK}={c}" for c, (_, where) in sorted(at.bases.items())))
        parts.append(found.select(*columns, F.col("base").alias("version")))
    if at.rows:
        found = spark.read.schema(under("version")).option("basePath", root).parquet(*(f"{root}/version={v}/kind=row/{CHUNK}={c}" for c, vs in sorted(at.rows.items()) for v in vs))
        parts.append(found.select(*columns, "version"))
    if not parts:
        return spark.createDataFrame([], schema_of(table))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if at.deletes:
        keys = keys_of(table)
        gone = spark.read.schema(under("version")).option("basePath", root).parquet(*(f"{root}/version={v}/kind=delete/{CHUNK}={c}" for c, vs in sorted(at.deletes.items()) for v in vs))
        gone = gone.select(*(F.col(k).alias(f"gone_{k}") for k in keys), F.col("version").alias("gone_at"))
        same = [F.col(k) == F.col(f"gone_{k}") for k in keys]
        rows = rows.join(gone, [*same, F.col("version") < F.col("gone_at")], "left_anti")  # few: those since the last base
    return rows.select(*columns)


def placed(rows: DataFrame, table: str) -> DataFrame:
    """Rows with the chunk that they belong to."""
    if table in BUCKETS:
        key, n = BUCKETS[table]
        return rows.withColumn(CHUNK, F.lpad(F.pmod(F.xxhash64(key), F.lit(n)).cast("string"), 4, "0"))
    if table not in CHUNKS:
        return rows.withColumn(CHUNK, F.lit(WHOLE))
    column, unit = CHUNKS[table]
    return rows.withColumn(CHUNK, F.date_format(F.date_trunc(unit, F.col(column)), "yyyy-MM-dd"))


def commit(rows: DataFrame, folder: str, table: str, *, deletes: DataFrame | None = None) -> int:
    """Adds rows as the table's next version, and takes back earlier rows by key, both at once; returns its number.

    ``deletes`` has the key columns, and the column that tells the chunk. A number is taken by making a file, which only one caller can.
    """
    spark, root = rows.sparkSession, f"{folder}/{table}"
    files = Files(spark, root)
    names = files.names(root)
    number = max([0, *numbered(names, "version"), *numbered(names, "base")]) + 1
    while not files.create_new(f"{root}/version={number}/_taken"):
        number += 1
    fields = [f.name for f in table_schema(table).fields]
    out = placed(rows.select(*fields), table).withColumn("kind", F.lit("row"))
    if deletes is not None:
        out = out.unionByName(placed(deletes, table).withColumn("kind", F.lit("delete")), allowMissingColumns=True)
    out.write.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").partitionBy("kind", CHUNK).parquet(f"{root}/version={number}")
    return number


def keys_of(table: str) -> list[str]:
    return KEYS[table] if table in KEYS else BUCKET_KEYS[table]


def put(rows: DataFrame, folder: str, table: str) -> int:
    """Adds rows in place of those with their keys. What is written follows the rows, not the table."""
    return commit(rows, folder, table, deletes=rows.select(*keys_of(table)))


def touched(spark: SparkSession, folder: str, table: str, keys: DataFrame) -> DataFrame:
    """The table's rows with the keys of some rows, read in their chunks only."""
    names = [c for c in keys_of(table) if c in keys.columns]
    wanted = placed(keys.select(*names).distinct(), table)
    chunks = [r[0] for r in wanted.select(CHUNK).distinct().collect()]
    return read(spark, folder, table).filter(F.col(CHUNK).isin(chunks)).join(wanted.drop(CHUNK), names, "left_semi")


def skipping(table: str, row_group: int = ROW_GROUP) -> dict[str, str]:
    """Write options by which readers skip row groups: small ones, and Bloom filters of the columns that rows are looked up by.

    A filter's size follows the number of distinct values in its row group, a megabyte at most. Parquet leaves it out
    where a column's dictionary tells the same.
    """
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in BLOOMS.get(table, ())}
    return {"parquet.block.size": str(row_group), **({"parquet.bloom.filter.adaptive.enabled": "true"} if blooms else {}), **blooms}


def compact(
    spark: SparkSession,
    folder: str,
    table: str,
    before: str | None = None,
    *,
    grace: float = GRACE,
    between: Callable[[], None] | None = None,
    fold: Callable[[DataFrame], DataFrame] | None = None,
    row_group: int = ROW_GROUP,
) -> int:
    """Rewrites the chunks that have later versions, all or those that start before a date; returns how many.

    Rows are clustered by segment and newest first, and a chunk is split over tasks by ranges of (segment, time), so a
    segment with most of a chunk's rows is no single task, and readers of one segment skip most files and row groups.
    Readers by another column skip row groups by Bloom filters (``skipping``). ``fold`` (of ``schemas.FOLDS`` if none is given) merges the rows of a table
    without time partitions. ``between`` is called when the rows are written and before they count.
    """
    root, at = f"{folder}/{table}", layout(spark, folder, table)
    chunks = sorted(c for c in {*at.rows, *at.deletes} if before is None or c < before)
    if chunks:
        frozen = Layout(at.newest, *({c: x for c, x in part.items() if c in chunks} for part in (at.bases, at.rows, at.deletes)))
        rows = read(spark, folder, table, frozen)
        fold = fold or FOLDS.get(table)
        if fold:
            rows = fold(rows.drop(CHUNK)).withColumn(CHUNK, F.lit(WHOLE))
        if table in SEGMENTS:
            order = (CHUNK, SEGMENTS[table], F.desc(CHUNKS[table][0]))
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        elif table in BUCKETS:  # ranges split a bucket that one key fills
            rows = rows.repartitionByRange(CHUNK, *keys_of(table)).sortWithinPartitions(CHUNK, *keys_of(table))
        else:
            rows = rows.repartition(CHUNK).sortWithinPartitions(CHUNK)
        where = f"{root}/base={at.newest}/run={run_name()}"
        rows.withColumn("kind", F.lit("row")).write.option("compression", "zstd").options(**skipping(table, row_group)).partitionBy("kind", CHUNK).parquet(where)
        if between:
            between()
        Files(spark, root).put(f"{where}/{CHUNK_LIST}", json.dumps(chunks))
    vacuum(spark, folder, table, grace=grace)
    return len(chunks)


def vacuum(spark: SparkSession, folder: str, table: str, *, grace: float = GRACE) -> None:
    """Removes chunk folders that no reader takes any more, and attempts that never counted, once they are older than the grace."""
    root = f"{folder}/{table}"
    files, at = Files(spark, root), layout(spark, folder, table)
    used = {f"{where}/kind=row/{CHUNK}={c}" for c, (_, where) in at.bases.items()}
    used |= {f"{root}/version={v}/kind={kind}/{CHUNK}={c}" for kind, part in (("row", at.rows), ("delete", at.deletes)) for c, vs in part.items() for v in vs}
    # the list of a base's chunks goes last: until then it hides the versions before it
    newest_of: dict[str, str] = {}
    names = files.names(root)
    runs = [f"{root}/base={n}/{run}" for n in numbered(names, "base") for run in runs_of(files, f"{root}/base={n}")]
    for run in runs:
        if files.exists(f"{run}/{CHUNK_LIST}"):
            newest_of |= dict.fromkeys(json.loads(files.text(f"{run}/{CHUNK_LIST}")), run)
    versions = [f"{root}/version={v}" for v in numbered(names, "version") if v <= at.newest]
    for owner in [*versions, *runs]:
        kept = False
        for kind in ("row", "delete"):
            for name, age in files.names(f"{owner}/kind={kind}").items():
                if f"{owner}/kind={kind}/{name}" in used or age < grace:
                    kept = True
                else:
                    files.delete(f"{owner}/kind={kind}/{name}")
        ages = files.names(owner)
        if not kept and owner not in newest_of.values() and ages and min(ages.values()) >= grace:
            files.delete(owner)


def replace_all(rows: DataFrame, folder: str, table: str) -> None:
    """Puts rows in place of all that a table without time partitions has."""
    spark, root = rows.sparkSession, f"{folder}/{table}"
    where = f"{root}/base={layout(spark, folder, table).newest}/run={run_name()}"
    placed(rows.select(*(f.name for f in table_schema(table).fields)), table).withColumn("kind", F.lit("row")).write.partitionBy("kind", CHUNK).parquet(where)
    Files(spark, root).put(f"{where}/{CHUNK_LIST}", json.dumps([WHOLE]))


def reset(spark: SparkSession, folder: str, table: str) -> None:
    """Empties a table: a base without rows for all its chunks."""
    root, at = f"{folder}/{table}", layout(spark, folder, table)
    Files(spark, root).put(f"{root}/base={at.newest}/run={run_name()}/{CHUNK_LIST}", json.dumps(sorted({*at.bases, *at.rows, *at.deletes})))
