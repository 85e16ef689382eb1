"""Continuous and bounded ingest through one code path and one writer.

What is to be written comes as landing rows, or as requests: ranges of ledgers in small files, which ``backfill`` and
``repair`` leave. The tail reads landing ledgers, landing transactions and requests as sources of one stream and alone
appends; where no tail runs, whoever asks serves the requests. A lease lets one of them write at a time.

A ledger is built whenever its landing row or one of its transactions arrives, from all that lies in the landing
folders by then. So they may land in any order and at any time: rows that are there are skipped, and a ledger whose
counts have changed replaces the row before it. The cursor is written after the tables, so a batch that failed half-way
is simply run again.
"""

from __future__ import annotations

import functools
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspring.operators import builders, contracts, deltas, gaps, rollups, writes
from tallyspring.schemas import BUCKETS, KEYS, LEDGERS_RAW, TRANSACTIONS_RAW, table_schema
from tallyspring.sources import landing
from tallyspring.streaming import publish, ticks
from tallyspring.streaming.lease import Lease, Lost

CURSOR = "last_ingested_ledger"
#: The first ledger of a tail, told once by its first run.
TAIL_START = "tail_start"
#: Tables of the writer's own that it compacts. Detected contracts stay as they came, for the stream that follows them.
STATE = ("ingestion_state", "ingest_counters", "quarantine", "ledger_presence")
#: What is counted of a batch.
COUNTS = ("ledgers", "transactions", "operations", "token_events", "contract_events", "errors", "publish_errors")
#: Columns of a ledger that its transactions change.
TALLIES = ["transaction_count", "operation_count", "successful_tx_count", "failed_tx_count"]
REQUEST = "request string, low bigint, high bigint"
#: Commits of a table after which the writer compacts what has changed.
MERGE_AFTER = 64
LOG = logging.getLogger(__name__)

Publisher = Callable[[DataFrame], None]


@dataclass
class Lake:
    """Folders of the landing rows, partitioned by ``part`` (see ``landing.land``), and of the tables."""

    ledgers: str
    transactions: str
    tables: str
    domain: bytes

    def domain_column(self) -> Column:
        return F.lit(bytearray(self.domain))

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return deltas.read(spark, self.tables, name)

    @property
    def requests(self) -> str:
        return f"{self.tables}/_requests"


def create_tables(spark: SparkSession, lake: Lake) -> None:
    """The folders that streams read. Tables need none: one without commits is empty."""
    files = deltas.Files(spark, lake.tables)
    for folder in (lake.ledgers, lake.transactions, lake.requests, f"{lake.tables}/detected_contracts", ticks.folder_of(lake.tables)):
        files.fs.mkdirs(files.path(folder))


def quarantined(bad: dict[str, DataFrame]) -> DataFrame:
    """Rows that couldn't be built, as (source, reason, ledger, row as JSON)."""
    parts = []
    for source, rows in bad.items():
        ledger = next(c for c in ("ledger_sequence", "sequence", "ledger") if c in rows.columns)
        told = F.to_json(F.struct(*(c for c in rows.columns if c != "reason")))
        parts.append(rows.select(F.lit(source).alias("source"), "reason", F.col(ledger).cast("bigint").alias("ledger"), told.alias("row")))
    return functools.reduce(DataFrame.union, parts)


def one_each(ledgers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one landing row for each ledger, the other rows that differ from it). Which one it is depends on the rows alone."""
    told = ledgers.withColumn("_told", F.to_json(F.struct(*ledgers.columns)))
    mine = Window.partitionBy("sequence").orderBy("_told")
    told = told.withColumns({"_n": F.row_number().over(mine), "_first": F.first("_told").over(mine)})
    return told.filter("_n = 1").select(*ledgers.columns), told.filter("_told <> _first").select(*ledgers.columns, F.lit("repeated").alias("reason")).distinct()


def process(spark: SparkSession, lake: Lake, ledgers: DataFrame, publisher: Publisher | None = None, *, request: str | None = None, check: Callable[[], None] = lambda: None) -> dict[str, int]:
    """Writes all tables for a batch of landing ledgers; returns its counts.

    Transactions are read for the batch's ledgers, out of their parts only. Bad rows go to quarantine, once each, and
    never stop a batch; of several landing rows of one ledger the first in the order of their JSON counts and the others go there. Messages are sent after the cursor; an error in sending is
    logged and counted, and nothing else. The counts are what the batch built, before rows that are there already are
    skipped; ``errors`` are its quarantined rows. ``check`` may raise before each write.
    """
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    try:
        raw = hold(ledgers.select(*(c for c in ledgers.columns if c != landing.PART)))
        seen, others = one_each(raw)
        seen = hold(seen)
        sequence = F.col("sequence")
        low, high, parts = seen.agg(F.min(sequence), F.max(sequence), F.collect_set(landing.lake_partition(sequence))).first()
        counts = dict.fromkeys(COUNTS, 0)
        if low is None:
            if request:
                finish(spark, lake, 0, 0, counts, request)
            return counts
        found = landing.ledger_range(landing.raw(spark, lake.transactions, TRANSACTIONS_RAW, parts).drop(landing.PART), low, high, "ledger")
        found = hold(found.join(seen.select(sequence.alias("ledger")), "ledger", "left_semi"))
        good, bad = {}, {"landing": others}
        good["ledgers"], bad["ledgers"] = builders.ledger_table(seen, found, hold=hold)
        good["transactions"], bad["transactions"] = builders.transaction_table(found, lake.domain_column())
        good["operations"], bad["operations"] = builders.operation_table(found, lake.domain_column(), hold)
        good["token_events"], bad["token_events"] = builders.token_event_table(seen, hold)
        good["contract_events"], bad["contract_events"] = builders.contract_event_table(found, lake.domain_column(), hold)
        for name in ("ledgers", "transactions", "operations"):
            check()
            counts[name] = writes.upsert(good[name], lake.tables, name, TALLIES if name == "ledgers" else [])
        check()
        deltas.commit(gaps.presence(good["ledgers"], "sequence"), lake.tables, "ledger_presence")
        append_ranged(contracts.detect(found), lake, "detected_contracts", ["contract_id", "created_ledger"], "created_ledger", low, high)
        for name in ("token_events", "contract_events"):
            check()
            counts[name] = writes.append(good[name], lake.tables, name)
        check()
        counts["errors"] = append_ranged(quarantined(bad), lake, "quarantine", ["source", "ledger", "row"], "ledger", low, high)
        set_cursor(spark, lake, high)
        if publisher:
            for messages in (publish.ledger_messages(good["ledgers"]), publish.transaction_messages(good["transactions"])):
                try:
                    publisher(messages)
                except Exception:
                    LOG.exception("messages of ledgers %s to %s weren't sent", low, high)
                    counts["publish_errors"] += 1
        finish(spark, lake, low, high, counts, request)
        return counts
    finally:
        for df in held:
            df.unpersist()


def finish(spark: SparkSession, lake: Lake, low: int, high: int, counts: dict[str, int], request: str | None) -> None:
    """The batch's row of counters; a request that it served goes."""
    row = spark.range(1, numPartitions=1).select(
        F.lit(low).cast("bigint").alias("low"), F.lit(high).cast("bigint").alias("high"), *(F.lit(counts[c]).cast("bigint").alias(c) for c in COUNTS), F.lit(request).cast("string").alias("request"), F.current_timestamp().alias("at")
    )
    deltas.commit(row, lake.tables, "ingest_counters")
    if request:
        deltas.Files(spark, lake.tables).delete(f"{lake.requests}/{request}")


def append_ranged(rows: DataFrame, lake: Lake, table: str, keys: list[str], column: str, low: int, high: int) -> int:
    """Adds the rows that a table without time partitions lacks, looking only at the batch's range of ledgers; returns how
    many rows the batch has, repeats included. They are counted as they pass, by no job of their own."""
    passed = Observation()
    rows = rows.observe(passed, F.count(F.lit(1)).alias("n")).dropDuplicates(keys).persist()
    try:
        if rows.isEmpty():  # else this has built all of them, as repeats meet in a shuffle
            return 0
        there = lake.table(rows.sparkSession, table).filter(F.col(column).between(low, high))
        deltas.commit(writes.insert_if_absent(rows, there, keys), lake.tables, table)
        return passed.get["n"]
    finally:
        rows.unpersist()


def totals(spark: SparkSession, lake: Lake) -> DataFrame:
    """One row: running totals of the counts of all batches, replays included."""
    return lake.table(spark, "ingest_counters").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS))


def errors_by_kind(spark: SparkSession, lake: Lake) -> DataFrame:
    """How many rows of each source are in quarantine for each reason; a replay doesn't raise it."""
    return lake.table(spark, "quarantine").groupBy("source", "reason").agg(F.count("*").alias("n_errors"))


def health(spark: SparkSession, lake: Lake, now: Column | None = None, limit: str = "2 minutes") -> DataFrame:
    """One row from the tail's newest tick, without a look at the tables: when it was, the newest ledger that had arrived,
    how many batches and rows there were since its start, and whether it is older than the limit. Before the first tick
    nothing is stale."""
    newest = ticks.last_tick(spark, lake.tables).agg(*(F.max(c).alias(c) for c in ("at", "high", "n_batches", "n_rows")))
    return newest.withColumn("stale", rollups.is_stale(F.col("at"), F.current_timestamp() if now is None else now, limit))


def put_state(lake: Lake, key: str, value: DataFrame) -> None:
    """A new row of state, from a DataFrame of one row and column."""
    row = value.toDF("value").select(F.lit(key).alias("key"), F.col("value").cast("string").alias("value"), F.current_timestamp().alias("updated_at"))
    deltas.commit(row, lake.tables, "ingestion_state")


def set_cursor(spark: SparkSession, lake: Lake, high: int) -> None:
    """A new row of state; the cursor is the greatest ever written, so it can't move back."""
    put_state(lake, CURSOR, spark.range(1, numPartitions=1).select(F.lit(high)))


def start_sequence(spark: SparkSession, lake: Lake) -> int:
    """Where a tail begins: what its first run found, which never changes after.

    The first run begins after the cursor, if ledgers were ingested before, or else at the newest ledger.
    """
    state = lake.table(spark, "ingestion_state")
    told = state.filter(F.col("key") == TAIL_START).agg(F.min(F.col("value").cast("bigint"))).first()[0]
    if told is not None:
        return told
    last = landing.cursor(state).first()[0]
    newest = landing.parts_there(spark, lake.ledgers)[-1:]
    start = last + 1 if last else landing.latest(landing.raw(spark, lake.ledgers, LEDGERS_RAW, newest)).first()[0] or 0
    put_state(lake, TAIL_START, spark.range(1, numPartitions=1).select(F.lit(start)))
    return start


# Requests: ranges of ledgers to read again, each in a folder of one small file.


def submit(spark: SparkSession, lake: Lake, ranges: DataFrame) -> str | None:
    """Leaves a request for (range_start, range_end) and returns its name; none for no ranges.

    It is there whole or not at all: the rows are written aside and the folder is renamed.
    """
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    aside = f"{lake.tables}/_asked/{name}"
    ranges.select(F.lit(name).alias("request"), F.col("range_start").cast("bigint").alias("low"), F.col("range_end").cast("bigint").alias("high")).repartition(1).write.parquet(aside)
    files = deltas.Files(spark, lake.tables)
    if spark.read.schema(REQUEST).parquet(aside).isEmpty():
        files.delete(aside)
        return None
    files.fs.rename(files.path(aside), files.path(f"{lake.requests}/{name}"))
    return name


def pending(spark: SparkSession, lake: Lake) -> list[str]:
    """Requests that nobody has served, oldest first."""
    return sorted(deltas.Files(spark, lake.tables).names(lake.requests))


def serve(spark: SparkSession, lake: Lake, request: str, publisher: Publisher | None = None, check: Callable[[], None] = lambda: None) -> dict[str, int]:
    """Processes the landing ledgers of a request; ranges without landing rows stay missing."""
    if request not in pending(spark, lake):
        return dict.fromkeys(COUNTS, 0)  # a replay of what was done
    there = landing.parts_there(spark, lake.ledgers)
    ranges = spark.read.schema(REQUEST).parquet(f"{lake.requests}/{request}").select(F.col("low").alias("range_start"), F.col("high").alias("range_end"))
    first, last = (there[0], there[-1]) if there else (0, -1)  # nothing lies outside
    per = landing.LEDGERS_PER_PARTITION
    ranges = ranges.select(F.greatest("range_start", F.lit(first * per)).alias("range_start"), F.least("range_end", F.lit(last * per + per - 1)).alias("range_end")).filter("range_start <= range_end")
    spans = [tuple(r) for r in ranges.select(landing.lake_partition(F.col("range_start")), landing.lake_partition(F.col("range_end"))).distinct().collect()]  # of parts
    there = [p for p in there if any(a <= p <= b for a, b in spans)]
    rows = landing.raw(spark, lake.ledgers, LEDGERS_RAW, there)
    return process(spark, lake, gaps.rows_in_ranges(rows, ranges, bucket=landing.LEDGERS_PER_PARTITION), publisher, request=request, check=check)


def served(spark: SparkSession, lake: Lake, request: str | None, wait: float = 3600) -> dict[str, int]:
    """Sees to it that a request is served, by a tail that runs or else here, and returns its counts."""
    until = time.monotonic() + wait
    while request in pending(spark, lake):
        lease = Lease(spark, lake.tables)
        if lease.take():
            try:
                for each in pending(spark, lake):
                    serve(spark, lake, each, check=lease.check)
                    merge_often(spark, lake)
            finally:
                lease.release()
        elif time.monotonic() > until:
            raise TimeoutError(f"request {request} wasn't served")
        else:
            time.sleep(0.3)
    told = lake.table(spark, "ingest_counters").filter(F.col("request") == request).first()
    return {c: told[c] if told else 0 for c in COUNTS}


def span(spark: SparkSession, start: int, end: int) -> DataFrame:
    return spark.range(1, numPartitions=1).select(F.lit(start).cast("bigint").alias("range_start"), F.lit(end).cast("bigint").alias("range_end"))


def backfill(spark: SparkSession, lake: Lake, start: int, end: int) -> dict[str, int]:
    """A bounded range through the same path and writer."""
    if end < start:
        raise ValueError(f"range ends at {end}, before its start {start}")
    return served(spark, lake, submit(spark, lake, span(spark, start, end)))


def absent(spark: SparkSession, lake: Lake, limit: int | None = 500) -> DataFrame | None:
    """Ranges that are missing between the first and the last ledger, at most ``limit`` ids; None without ledgers.

    Read from the bitmaps that each batch leaves beside the ledgers, 4 KB for 32,768 of them.
    """
    bitmaps = lake.table(spark, "ledger_presence")
    ends = bitmaps.agg(F.min("bucket"), F.max("bucket")).first()
    if ends[0] is None:
        return None
    edge = bitmaps.filter(F.col("bucket").isin(*set(ends))).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    bits = {r["bucket"]: int.from_bytes(r["bits"], "little") for r in edge.collect()}
    first, last = bits[ends[0]], bits[ends[1]]
    low, high = ends[0] * gaps.BITS + (first & -first).bit_length() - 1, ends[1] * gaps.BITS + last.bit_length() - 1
    ranges = gaps.absent_ranges(bitmaps, low, high)
    return ranges if limit is None else gaps.first_ids(ranges, limit)


def repair(spark: SparkSession, lake: Lake, limit: int | None = 500) -> dict[str, int]:
    """Reads again what is missing; ranges without landing rows stay missing."""
    ranges = absent(spark, lake, limit)
    if ranges is None:
        return dict.fromkeys(COUNTS, 0)
    return served(spark, lake, submit(spark, lake, ranges))


def repair_regularly(spark: SparkSession, lake: Lake, checkpoint: str, *, every: str = "5 minutes", limit: int | None = 500) -> StreamingQuery:
    """Runs ``repair`` at set times, also beside a tail, which then does the writing. A repair that fails is logged; the next one tries again."""

    def tick(_: DataFrame, __: int) -> None:
        try:
            repair(spark, lake, limit)
        except Exception:
            LOG.exception("repair failed")

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def merge_often(spark: SparkSession, lake: Lake, after: int = MERGE_AFTER, names: tuple[str, ...] = (*KEYS, *STATE)) -> None:
    """Compacts tables that have had many commits, so that the files that a reader lists stay few."""
    for name in names:
        root = f"{lake.tables}/{name}"
        if len(deltas.numbered(deltas.Files(spark, root).names(root), "version")) > after:
            deltas.compact(spark, lake.tables, name, grace=600)


def tail(
    spark: SparkSession, lake: Lake, checkpoint: str, *, files_per_batch: int = 100, every: str = "1 second", once: bool = False, publisher: Publisher | None = None, wait: float = 60, merge_after: int = MERGE_AFTER
) -> StreamingQuery:
    """Follows the landing folders from the first run's start on, and serves requests meanwhile.

    Late ledgers and transactions are taken at any age, as each row has a key: whatever lies at or after the start that
    the first run stored is ingested, in whatever order and after however many restarts it lands. Ledgers before it are
    history, which ``backfill`` and ``repair`` ask for. Each trigger leaves a tick (see ``ticks``), of which ``health`` tells. Raises ``Lost`` if another writer doesn't end within ``wait`` seconds.
    """
    lease = Lease(spark, lake.tables)
    if not lease.take(wait):
        raise Lost(f"another writer has {lake.tables}")
    try:
        start = start_sequence(spark, lake)
        since = start // landing.LEDGERS_PER_PARTITION

        def landed(path: str, schema: str, column: str) -> DataFrame:
            stream = spark.readStream.schema(f"{schema}, {landing.PART} bigint").option("basePath", path).option("maxFilesPerTrigger", files_per_batch)
            rows = stream.parquet(landing.parts_from(path, since)).filter(F.col(column) >= start)
            return rows.select(F.lit(None).cast("string").alias("request"), F.col(column).alias("low"))

        asked = spark.readStream.schema(REQUEST).option("ignoreMissingFiles", True).option("maxFilesPerTrigger", files_per_batch).parquet(f"{lake.requests}/*")
        arrived = landed(lake.ledgers, LEDGERS_RAW, "sequence").unionByName(landed(lake.transactions, TRANSACTIONS_RAW, "ledger")).unionByName(asked.select("request", "low"))
        arrived, name = ticks.observed(arrived, "low"), f"tail-{uuid.uuid4().hex}"

        def write(batch: DataFrame, _: int) -> None:
            lease.check()
            batch = batch.distinct().persist()
            try:
                touched = batch.filter("request IS NULL").select(F.col("low").alias("sequence"))
                parts = [r[0] for r in touched.select(landing.lake_partition(F.col("sequence"))).distinct().collect()]
                if parts:
                    process(spark, lake, landing.raw(spark, lake.ledgers, LEDGERS_RAW, parts).join(touched, "sequence", "left_semi"), publisher, check=lease.check)
                for (request,) in batch.filter("request IS NOT NULL").select("request").distinct().orderBy("request").collect():
                    serve(spark, lake, request, publisher, lease.check)
            finally:
                batch.unpersist()
            merge_often(spark, lake, merge_after)

        spark.streams.addListener(ticks.Ticks(spark, lake.tables, name))
        writer = arrived.writeStream.foreachBatch(write).queryName(name).option("checkpointLocation", checkpoint)
        query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
        lease.release_after(query.awaitTermination)
        return query
    except BaseException:
        lease.release()
        raise


def follow_contracts(spark: SparkSession, lake: Lake, instances: DataFrame, codes: DataFrame, metadata: DataFrame, checkpoint: str, *, contracts_per_batch: int = 100) -> StreamingQuery:
    """A side stream over detected contracts, into contracts and their code; its failures never stop the main one.

    A batch writes what it changes (``writes.write_contracts``), and a replayed one gives the same again.
    ``contracts_per_batch`` is in files of detections.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        new = contracts.contract_rows(batch, instances, codes, metadata).persist()
        try:
            if not new.isEmpty():
                writes.write_contracts(new, lambda used: contracts.code_rows(used, codes), lake.tables)
                for name in BUCKETS:
                    merge_often(spark, lake, names=(name,))
        finally:
            new.unpersist()

    root = f"{lake.tables}/detected_contracts"
    detected = spark.readStream.schema(table_schema("detected_contracts")).option("maxFilesPerTrigger", contracts_per_batch).option("ignoreMissingFiles", True).parquet(f"{root}/version=*/kind=row/chunk=*")
    return detected.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, keys: list[str], time: str, within: str = "1 hour") -> DataFrame:
    """In-stream removal of repeats that come within a time of each other."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
