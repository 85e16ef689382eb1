"""Multiplexed addresses: split once for each distinct address, then joined back."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspring.functions.scalars import wrapped_long

# Version bytes of the two address kinds.
ACCOUNT_VERSION, MUXED_VERSION = 6 << 3, 12 << 3


def checksum(raw: bytes) -> bytes:
    """CRC-16 with polynomial 0x1021 and start 0, low byte first."""
    crc = 0
    for byte in raw:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc.to_bytes(2, "little")


def decode_muxed(address: str) -> tuple[str | None, int | None]:
    """Base address and id of an ``M`` address, whose payload is the key and then the id; nulls if it is broken."""
    try:
        raw = base64.b32decode(address + "=" * (-len(address) % 8))
    except ValueError:
        return None, None
    if len(raw) != 43 or raw[0] != MUXED_VERSION or checksum(raw[:-2]) != raw[-2:]:
        return None, None
    body = bytes([ACCOUNT_VERSION]) + raw[1:33]
    return base64.b32encode(body + checksum(body)).decode().rstrip("="), int.from_bytes(raw[33:41], "big")


def split_addresses(df: DataFrame, column: str, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds <column>_base, <column>_muxed and <column>_muxed_id.

    A plain address, or none, is its own base and isn't moved. Only rows with an ``M`` address meet the join with their
    decoded, distinct addresses. A broken ``M`` address has a null base. ``hold`` may persist the
    rows, which are read three times.
    """
    df = hold(df)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [decode_muxed(a) for a in batch["_address"]]
            yield pd.DataFrame({"_address": batch["_address"], "_base": [b for b, _ in found], "_id": [None if i is None else str(i) for _, i in found]})

    muxed: Column = F.coalesce(F.col(column).startswith("M"), F.lit(False))
    none = F.lit(None).cast("string")
    plain = df.filter(~muxed).select(*df.columns, F.col(column).alias(f"{column}_base"), none.alias(f"{column}_muxed"), none.cast("bigint").alias(f"{column}_muxed_id"))
    those = df.filter(muxed)
    decoded = those.select(F.col(column).alias("_address")).distinct().mapInPandas(decode, "_address string, _base string, _id string")
    joined = those.join(decoded, those[column] == decoded["_address"], "left")
    split = joined.select(*(those[c] for c in df.columns), F.col("_base").alias(f"{column}_base"), those[column].alias(f"{column}_muxed"), wrapped_long(F.col("_id").cast("decimal(20,0)")).alias(f"{column}_muxed_id"))
    return plain.union(split)
