"""Statistics, listings and searches over the target tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, time: str, n: int = 5) -> DataFrame:
    """The n newest rows, all columns breaking ties."""
    return df.orderBy(F.desc(time), *(c for c in df.columns if c != time)).limit(n)


#: Columns by which the newest rows of a table are looked up, and the rows that such a look-up is about.
ACCESS_PATHS = {
    "transactions": {"hash": None, "account": None, "ledger_sequence": None, "is_soroban": "is_soroban"},
    "operations": {"transaction_hash": None, "type": None, "source_account": None, "destination": "destination IS NOT NULL", "asset_code": "asset_code IS NOT NULL", "contract_id": "contract_id IS NOT NULL"},
    "contract_events": {"contract_id": None, "topic_1": "topic_1 IS NOT NULL", "transaction_hash": None, "ledger_sequence": None},
    "token_events": {"from_address": "from_address IS NOT NULL", "to_address": "to_address IS NOT NULL", "asset_code": "asset_code IS NOT NULL", "transaction_hash": None, "ledger_sequence": None},
}


def newest_where(df: DataFrame, table: str, values: dict[str, object], time: str = "created_at", n: int = 20) -> DataFrame:
    """The n newest rows whose columns have the values, such as a contract's with a topic.

    The values and the path's own condition are plain filters, so they reach the scan, which skips files and row groups
    of ``deltas.compact`` by their ends, dictionaries and Bloom filters. A value has its column's type; a cast around the
    column would keep the filter from the scan.
    """
    paths = ACCESS_PATHS[table]
    if unknown := set(values) - set(paths):
        raise ValueError(f"no access path of {table} by {sorted(unknown)}")
    found = df
    for column, value in values.items():
        found = found.filter(F.col(column) == F.lit(value).cast(df.schema[column].dataType))
        found = found.filter(paths[column]) if paths[column] else found
    return newest(found, time, n)


def newest_by_key(df: DataFrame, key: str, time: str, n: int, ties: list[str]) -> DataFrame:
    """The n newest rows of each key. Spark limits each task's rows of a key before the shuffle."""
    ranked = df.withColumn("rank_in_key", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), *ties)))
    return ranked.filter(F.col("rank_in_key") <= n)


def daily_stats(transactions: DataFrame, *, time: str, fee: str, flag: Column, amount: str | None = None) -> DataFrame:
    """Counts of each day, running totals, mean fee and share of flagged rows."""
    by_day = transactions.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n_day"), F.avg(fee).alias("avg_fee"), (F.count_if(flag) * 100 / F.count("*")).cast("decimal(5,2)").alias("flag_share"))
    return with_running_total(by_day)


def with_running_total(by_day: DataFrame) -> DataFrame:
    """The window runs over days, not rows."""
    return by_day.withColumn("n_total", F.sum("n_day").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def close_gaps(ledgers: DataFrame, sequence: str = "sequence", closed_at: str = "closed_at", bucket: int = 64_000) -> DataFrame:
    """(closed_at, gap): seconds from each ledger's predecessor to it; none for the first.

    Neighbours are found inside buckets of sequences; the first of a bucket takes the last of the bucket before it from
    a window over buckets, of which there are few.
    """
    rows = ledgers.select(F.col(sequence).alias("_at"), F.col(closed_at).alias("closed_at"), F.floor(F.col(sequence) / bucket).alias("_bucket"))
    by = Window.partitionBy("_bucket").orderBy("_at")
    inner = rows.select("closed_at", (F.unix_timestamp("closed_at") - F.unix_timestamp(F.lag("closed_at").over(by))).alias("gap"))
    ends = rows.groupBy("_bucket").agg(F.min_by("closed_at", "_at").alias("closed_at"), F.max_by("closed_at", "_at").alias("_last"))
    edges = ends.select("closed_at", (F.unix_timestamp("closed_at") - F.unix_timestamp(F.lag("_last").over(Window.orderBy("_bucket")))).alias("gap"))
    return inner.union(edges).filter("gap is not null")


def network_stats(ledgers: DataFrame, transactions: DataFrame, *, sequence: str = "sequence", closed_at: str = "closed_at", time: str = "created_at", fee: str = "fee_charged", flag: Column | None = None, bucket: int = 64_000) -> DataFrame:
    """One row for each day with transactions: those of ``daily_stats`` and the mean seconds between its ledgers."""
    days = daily_stats(transactions, time=time, fee=fee, flag=F.col("is_soroban") if flag is None else flag)
    closes = close_gaps(ledgers, sequence, closed_at, bucket).groupBy(F.to_date("closed_at").alias("day")).agg(F.avg("gap").alias("avg_close_seconds"))
    return days.join(closes, "day", "left")


def activity(events: DataFrame, key: str, name: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias(name))


def contract_activity(contracts: DataFrame, events: DataFrame, operations: DataFrame, key: str = "contract_id") -> DataFrame:
    """Contracts with their event_count and invocation_count, zeros included. Counts are aggregated before the joins."""
    of_events, of_operations = activity(events, key, "event_count"), activity(operations.filter(F.col(key).isNotNull()), key, "invocation_count")
    joined = contracts.join(of_events, key, "left").join(of_operations, key, "left")
    return joined.select(*contracts.columns, F.coalesce("event_count", F.lit(0)).alias("event_count"), F.coalesce("invocation_count", F.lit(0)).alias("invocation_count"))


def supply_change() -> Column:
    """What an event adds to the supply of its asset."""
    return F.when(F.col("event_type_name") == "mint", F.col("amount")).when(F.col("event_type_name").isin("burn", "clawback"), -F.col("amount")).otherwise(0)


def asset_supply(token_events: DataFrame) -> DataFrame:
    """Supply of each issued asset: mints less burns and clawbacks."""
    return token_events.filter("asset_code is not null").groupBy("asset_code", "asset_issuer").agg(F.sum(supply_change()).alias("supply"))


def balances(token_events: DataFrame) -> DataFrame:
    """Balance of each holder and asset, from both sides of each event."""
    asset = ["asset_code", "asset_issuer"]
    got = token_events.select(*asset, F.col("to_address").alias("holder"), F.col("amount"))
    gave = token_events.select(*asset, F.col("from_address").alias("holder"), (-F.col("amount")).alias("amount"))
    return got.union(gave).filter("holder is not null").groupBy(*asset, "holder").agg(F.sum("amount").alias("balance"))


def holders(balance: DataFrame) -> DataFrame:
    return balance.filter("balance > 0").groupBy("asset_code", "asset_issuer").agg(F.count("*").alias("holder_count"))


def rich_list(df: DataFrame, *, group: str, amount: str, n: int, ties: list[str]) -> DataFrame:
    """The n greatest amounts of each group."""
    ranked = df.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(amount), *ties)))
    return ranked.filter(F.col("rank_in_group") <= n)


def ohlc(trades: DataFrame, *, pair: list[str], time: str, price: str, tie: str) -> DataFrame:
    """Open, high, low, close and count of each pair and day."""
    at = F.struct(time, tie)
    return trades.groupBy(*pair, F.to_date(time).alias("day")).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("n_trades"))


def offer_book(offers: DataFrame, buckets: int = 1) -> DataFrame:
    """Offers with their decimal price, best first inside each pair.

    With more than one bucket, a pair is cut into that many parts by price, at quantiles of its own prices. Offers are
    numbered inside a part and moved by the size of the parts before it, so that a hot pair is spread over tasks.
    """
    priced = offers.withColumn("price", F.try_divide(F.col("price_n").cast("decimal(20,0)"), F.col("price_d").cast("decimal(20,0)")).cast("decimal(20,10)"))
    pair = ["selling", "buying"]
    if buckets < 2:
        return priced.withColumn("place", F.row_number().over(Window.partitionBy(*pair).orderBy("price", "offer_id")))
    shares = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    cuts = priced.groupBy(*pair).agg(F.approx_percentile("price", shares).alias("_cuts"))
    same = lambda a, b: [a[c].eqNullSafe(b[f"_{c}"]) for c in pair]
    cuts = cuts.select(*(F.col(c).alias(f"_{c}") for c in pair), "_cuts")
    # equal prices are in one part; an offer without a price stands first, as null sorts
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("price"))), F.lit(0)).alias("_part")
    dealt = priced.join(cuts, same(priced, cuts), "left").select(*priced.columns, part)
    sizes = dealt.groupBy(*pair, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*pair).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select(*(F.col(c).alias(f"_{c}") for c in pair), F.col("_part").alias("_part2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(*pair, "_part").orderBy("price", "offer_id"))
    placed = dealt.withColumn("_inside", inside)
    out = placed.join(ahead, [*same(placed, ahead), placed["_part"] == ahead["_part2"]])
    return out.select(*priced.columns, (F.col("_inside") + F.col("_ahead")).cast("int").alias("place"))


def expiring(storage: DataFrame, ledger: int) -> DataFrame:
    return storage.filter(F.col("ttl_ledger").isNotNull() & (F.col("ttl_ledger") < ledger))


def label_search(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Rows whose text has any of the words, in any case; words are as written, without stemming."""
    return df.filter(F.arrays_overlap(F.split(F.lower(F.col(column)), r"\W+"), F.array(*(F.lit(w.lower()) for w in words))))


def rows_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows a key has: more than one shows a replay that wasn't idempotent."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def lag_behind(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """How far the target is behind the source; never under 0."""
    tip = source.agg(F.max(column).alias("tip"))
    last = target.agg(F.coalesce(F.max(column), F.lit(0)).alias("last"))
    return tip.crossJoin(last).select("tip", "last", F.greatest(F.col("tip") - F.col("last"), F.lit(0)).alias("behind"))  # one row each


def is_stale(updated_at: Column, now: Column, limit: str = "2 minutes") -> Column:
    """Whether the last tick is older than the limit; before the first tick nothing is stale."""
    return F.coalesce(now - updated_at > F.expr(f"interval {limit}"), F.lit(False))
