"""Aggregates kept as partial rows: each step adds those of what came since the last one, readers merge them by key.

All aggregates here merge: sums and counts add up, ends are least and greatest structs of (time, tie, value). So the state
after any number of steps, over rows in any order and however late, equals the aggregate of all rows. A step is one commit, which also tells up
to which version of the source it goes; a step that died half-way has told nothing, and the next one does it again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspring.operators import deltas, rollups
from tallyspring.schemas import MERGES, STATE_KEYS, table_schema

UPTO = "upto"


@dataclass(frozen=True)
class Aggregate:
    """``parts`` makes (keys, partial columns) of source rows, not yet grouped; ``result`` what readers get of merged rows."""

    source: str
    parts: Callable[[DataFrame], DataFrame]
    result: Callable[[DataFrame], DataFrame] = lambda merged: merged


def merged(rows: DataFrame, table: str) -> DataFrame:
    """One row for each key."""
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    types = {f.name: f.dataType for f in table_schema(table).fields}
    return rows.groupBy(*STATE_KEYS[table]).agg(*(how[m](c).cast(types[c]).alias(c) for c, m in MERGES[table].items()))


def move(events: DataFrame) -> DataFrame:
    """Signed amounts of both sides of each event."""
    asset = ["asset_code", "asset_issuer"]
    sides = F.array(F.struct(F.col("to_address").alias("holder"), F.col("amount").alias("balance")), F.struct(F.col("from_address").alias("holder"), (-F.col("amount")).alias("balance")))
    return events.select(*asset, F.explode(sides).alias("side")).select(*asset, "side.*").filter("holder IS NOT NULL")


def supply(events: DataFrame) -> DataFrame:
    return events.filter("asset_code IS NOT NULL").select("asset_code", "asset_issuer", rollups.supply_change().cast("decimal(38,0)").alias("supply"))


def days(transactions: DataFrame) -> DataFrame:
    soroban = F.coalesce("is_soroban", F.lit(False)).cast("bigint")
    return transactions.select(F.to_date("created_at").alias("day"), F.lit(1).cast("bigint").alias("n"), "fee_charged", F.col("fee_charged").isNotNull().cast("bigint").alias("n_fees"), soroban.alias("n_soroban")).withColumnRenamed("fee_charged", "fees")


def day_result(by_day: DataFrame) -> DataFrame:
    """The columns of ``rollups.daily_stats``."""
    told = by_day.select("day", F.col("n").alias("n_day"), F.try_divide("fees", "n_fees").alias("avg_fee"), (F.col("n_soroban") * 100 / F.col("n")).cast("decimal(5,2)").alias("flag_share"))
    return rollups.with_running_total(told)


def contract_events(events: DataFrame) -> DataFrame:
    return events.select("contract_id", F.lit(1).cast("bigint").alias("event_count"))


def transfers_by_day(events: DataFrame) -> DataFrame:
    """Candles of the amounts of transfers: first, last, least and greatest of each asset and day."""
    at = F.struct(F.col("created_at").alias("at"), F.col("ledger_sequence").alias("ledger"), F.col("event_ordinal").alias("ordinal"), "amount")
    rows = events.filter("asset_code IS NOT NULL AND event_type_name = 'transfer'")
    return rows.select("asset_code", "asset_issuer", F.to_date("created_at").alias("day"), at.alias("open"), F.col("amount").alias("high"), F.col("amount").alias("low"), at.alias("close"), F.lit(1).cast("bigint").alias("n"))


def candle_result(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"open": F.col("open.amount"), "close": F.col("close.amount")})


AGGREGATES = {
    "agg_balances": Aggregate("token_events", move),
    "agg_supply": Aggregate("token_events", supply),
    "agg_transfer_candles": Aggregate("token_events", transfers_by_day, candle_result),
    "agg_days": Aggregate("transactions", days, day_result),
    "agg_contract_events": Aggregate("contract_events", contract_events),
}


def added(spark: SparkSession, folder: str, table: str, after: int) -> tuple[DataFrame | None, int]:
    """Rows that versions after one added, and the newest version; None for the rows if the versions aren't all there any more."""
    root = f"{folder}/{table}"
    files, at = deltas.Files(spark, root), deltas.layout(spark, folder, table)
    names = files.names(root)
    there = [v for v in deltas.numbered(names, "version") if v > after and files.exists(f"{root}/version={v}/_SUCCESS")]
    if at.newest <= after:
        return deltas.read(spark, folder, table).limit(0), at.newest
    based = max([n for n, _ in at.bases.values()], default=0)
    # a base took in versions that may be gone
    if based > after and set(range(after + 1, based + 1)) - set(deltas.numbered(names, "version")):
        return None, at.newest
    paths: dict[str, list[int]] = {}
    for v in there:
        if deltas.chunks_in(files, f"{root}/version={v}/kind=delete"):
            raise ValueError(f"{table} takes rows back, which sums can't follow")
        for chunk in deltas.chunks_in(files, f"{root}/version={v}/kind=row"):
            paths.setdefault(chunk, []).append(v)
    return deltas.read(spark, folder, table, deltas.Layout(at.newest, {}, paths, {})), at.newest


def step(spark: SparkSession, folder: str, name: str) -> int:
    """Takes in what the source has had since the last step; returns the version that the state now stands at.

    One caller at a time for each aggregate. Where versions since the last step were compacted and removed, the state is
    worked out anew from the whole source.
    """
    aggregate = AGGREGATES[name]
    after = deltas.read(spark, folder, name).agg(F.coalesce(F.max(UPTO), F.lit(0))).first()[0]
    fresh, upto = added(spark, folder, aggregate.source, after)
    if upto == after:
        return after
    if fresh is None:
        fresh = deltas.read(spark, folder, aggregate.source)
        deltas.replace_all(stamped(merged(aggregate.parts(fresh), name), upto), folder, name)
    else:
        deltas.commit(stamped(merged(aggregate.parts(fresh), name), upto), folder, name)
    return upto


def stamped(rows: DataFrame, upto: int) -> DataFrame:
    """The rows with the version that they go up to, and a row without keys that tells it where there are no others."""
    mark = rows.sparkSession.range(1, numPartitions=1).select(F.lit(upto).cast("bigint").alias(UPTO))
    return rows.withColumn(UPTO, F.lit(upto).cast("bigint")).withColumn("mark", F.lit(False)).unionByName(mark.withColumn("mark", F.lit(True)), allowMissingColumns=True)


def result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return AGGREGATES[name].result(merged(deltas.read(spark, folder, name).filter("NOT mark"), name))


def compact(spark: SparkSession, folder: str, name: str, **options) -> int:
    """Merges the partial rows of each key into one."""

    def fold(rows: DataFrame) -> DataFrame:
        marks = rows.filter("mark").groupBy("mark").agg(F.max(UPTO).alias(UPTO))
        upto = rows.filter("NOT mark").groupBy(*STATE_KEYS[name]).agg(F.max(UPTO).alias(UPTO))
        ends = [F.col(k).eqNullSafe(F.col(f"u_{k}")) for k in STATE_KEYS[name]]
        kept = merged(rows.filter("NOT mark"), name).join(upto.select(*(F.col(k).alias(f"u_{k}") for k in STATE_KEYS[name]), UPTO), ends).drop(*(f"u_{k}" for k in STATE_KEYS[name]))
        return kept.withColumn("mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)

    return deltas.compact(spark, folder, name, fold=fold, **options)
