"""One writer at a time: a file in the tables' folder, made atomically, touched while its owner lives."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from tallyspring.operators.deltas import Files

#: Seconds after which a lease that nobody touched is free, and between touches.
EXPIRES, BEAT = 60, 10


class Lost(RuntimeError):
    """Another writer has the lease."""


class Lease:
    def __init__(self, spark: SparkSession, folder: str):
        self.files, self.name, self.owner = Files(spark, folder), f"{folder}/_writer", uuid.uuid4().hex
        self.ended = threading.Event()
        self.folder = folder

    def take(self, wait: float = 0) -> bool:
        """Whether the lease is ours; waits so many seconds for another owner to end."""
        until = time.monotonic() + wait
        while True:
            age = self.files.names(self.folder).get("_writer")
            if age is not None and age > EXPIRES:  # its owner died
                self.files.delete(self.name)
            if self.files.create_new(self.name):
                out = self.files.fs.create(self.files.path(self.name), True)
                out.write(bytearray(self.owner.encode()))
                out.close()
                if self.held():
                    threading.Thread(target=self._beat, daemon=True).start()
                    return True
            if time.monotonic() >= until:
                return False
            time.sleep(0.2)

    def held(self) -> bool:
        try:
            return self.files.text(self.name) == self.owner
        except Exception:  # gone, or being written by another
            return False

    def check(self) -> None:
        """Ends a writer that was taken for dead before it writes more."""
        if not self.held():
            raise Lost(f"another writer has {self.name}")

    def _beat(self) -> None:
        while not self.ended.wait(BEAT):
            if not self.held():
                return
            self.files.fs.setTimes(self.files.path(self.name), int(time.time() * 1000), -1)

    def release_after(self, wait: Callable[[], object]) -> None:
        """Gives the lease back when a wait ends, however it ends."""

        def run() -> None:
            with contextlib.suppress(Exception):
                wait()
            self.release()

        threading.Thread(target=run, daemon=True).start()

    def release(self) -> None:
        self.ended.set()
        if self.held():
            self.files.delete(self.name)
