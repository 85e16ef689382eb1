"""Ticks of a stream: after each trigger a listener leaves one small file that tells how it went.

What a tick tells comes from the query's own progress and from metrics that it observes on its rows as they pass, so no
job counts them. The newest tick alone is kept. Whether a writer is alive, and how far behind it is, is read from it.
"""

from __future__ import annotations

import json
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tallyspring.operators.deltas import Files

#: ``low``, ``high`` and ``arrived`` are of the newest batch with rows; ``n_batches`` and ``n_rows`` add up since the query's start.
TICK = "query string, at timestamp, batch bigint, idle boolean, low bigint, high bigint, arrived bigint, seconds double, n_batches bigint, n_rows bigint"
OBSERVED = "arrivals"
LOG = logging.getLogger(__name__)


def folder_of(tables: str) -> str:
    return f"{tables}/_ticks"


def observed(rows: DataFrame, column: str) -> DataFrame:
    """The rows, whose number and range of a column the query tells in its progress."""
    return rows.observe(OBSERVED, F.min(column).alias("low"), F.max(column).alias("high"), F.count(F.lit(1)).alias("arrived"))


class Ticks(StreamingQueryListener):
    """Listens to the query of one name, until that ends. An error in leaving a tick is logged, and the next one tries again."""

    def __init__(self, spark: SparkSession, tables: str, name: str):
        self.spark, self.files, self.folder, self.name = spark, Files(spark, tables), folder_of(tables), name
        self.id, self.n = None, 0
        self.told = {"query": name, "batch": None, "low": None, "high": None, "arrived": None, "seconds": None, "n_batches": 0, "n_rows": 0}

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.id = event.id

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.id != self.id:
            return
        if p.numInputRows:
            self.told |= {"batch": p.batchId, "seconds": p.batchDuration / 1000, "n_batches": self.told["n_batches"] + 1}
            row = p.observedMetrics.get(OBSERVED)
            if row is not None and row["arrived"]:
                self.told |= {c: row[c] for c in ("low", "high", "arrived")} | {"n_rows": self.told["n_rows"] + row["arrived"]}
        self.leave(idle=not p.numInputRows)

    def onQueryIdle(self, event) -> None:
        if event.id == self.id:
            self.leave(idle=True)

    def onQueryTerminated(self, event) -> None:
        if event.id == self.id:
            self.spark.streams.removeListener(self)

    def leave(self, idle: bool) -> None:
        """The new tick first, then the ones before it go, so that there is always one."""
        try:
            self.n += 1
            new = f"{time.time_ns():020d}.json"
            at = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
            self.files.put(f"{self.folder}/{new}", json.dumps(self.told | {"at": at, "idle": idle}))
            for name in self.files.names(self.folder):
                if name < new:
                    self.files.delete(f"{self.folder}/{name}")
        except Exception:
            LOG.exception("a tick of %s wasn't left", self.name)


def last_tick(spark: SparkSession, tables: str) -> DataFrame:
    """The newest tick, or no row before the first one."""
    names = [n for n in Files(spark, tables).names(folder_of(tables)) if n.endswith(".json")]
    if not names:
        return spark.createDataFrame([], TICK)
    return spark.read.schema(TICK).option("ignoreMissingFiles", True).json(f"{folder_of(tables)}/{max(names)}")
