"""The forwarder: a durable spool of row batches, and a streaming query with its own checkpoint for each destination.

Delivery is at least once: a batch whose query dies between sending and committing is sent again. A file in the spool is
whole or isn't there (Spark's committer moves it in when it is written); what a dead writer leaves behind is never read. An outage of one
destination doesn't hold back another. The spool may be bounded: files that every destination has taken go first, and only
then the oldest of the rest, which are counted as dropped; a file above the bound drops only itself.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schema import LOG_SCHEMA, normalise
from ..sources.manifest import Files


#: Bytes of spooled files in one batch, about.
BATCH_BYTES = 2 << 20


class Unavailable(RuntimeError):
    """The destination can't take rows now: try again."""


class Rejected(RuntimeError):
    """The destination will never take these rows: they go to the dead-letter folder."""


def backoff(attempt: int, least: float = 0.1, most: float = 10.0) -> float:
    """Seconds before attempt (from 0): doubled from least, most at most."""
    return min(most, least * 2 ** min(attempt, 60))


@dataclass
class DestinationStats:
    sent: int = 0
    retries: int = 0
    rejected: int = 0
    last_error: str = ""


@dataclass
class QueueStats:
    """The spool as one destination sees it; nothing pending: all that was accepted has been delivered."""

    pending_files: int
    pending_bytes: int
    acked_batches: int
    dropped_files: int
    dropped_bytes: int


class Forwarder:
    def __init__(self, spark: SparkSession, root: str, destinations: dict[str, Callable[[DataFrame, int], None]], max_spool_bytes: int = 0, least_wait: float = 0.1, most_wait: float = 10.0, bytes_per_batch: int = BATCH_BYTES):
        self.spark, self.root, self.destinations, self.max_spool_bytes = spark, root.rstrip("/"), destinations, max_spool_bytes
        self.least_wait, self.most_wait, self.bytes_per_batch = least_wait, most_wait, bytes_per_batch
        self._stopping = threading.Event()
        self.files = Files(spark, root)
        self.stats = {name: DestinationStats() for name in destinations}
        self.dropped_files = self.dropped_bytes = 0
        self.queries: dict = {}

    def add_rows(self, rows: DataFrame) -> None:
        """Appends rows to the spool; they are durable when this returns."""
        normalise(rows).write.mode("append").parquet(f"{self.root}/spool")
        self.enforce_bound()

    def enforce_bound(self) -> None:
        if not self.max_spool_bytes:
            return
        held = self._held()
        total = sum(size for _, _, size in held)
        if total <= self.max_spool_bytes:
            return
        taken = set.intersection(*[self._acked(name)[0] for name in self.destinations]) if self.destinations else set()
        # delivered files, then files above the bound, then by age
        for _, name, size in sorted(held, key=lambda h: (h[1] not in taken, h[2] <= self.max_spool_bytes)):
            if total <= self.max_spool_bytes:
                break
            self.files.delete(f"{self.root}/spool/{name}")
            total -= size
            if name not in taken:
                self.dropped_files += 1
                self.dropped_bytes += size

    def _held(self) -> list[tuple[int, str, int]]:
        """(modified, name, bytes) of the spool's files, oldest first."""
        at = f"{self.root}/spool"
        found = self.files.fs.listStatus(self.files.path(at)) if self.files.exists(at) else []
        return sorted((s.getModificationTime(), s.getPath().getName(), s.getLen()) for s in found if s.getPath().getName().endswith(".parquet"))

    def _acked(self, name: str) -> tuple[set[str], int]:
        """Names of the files that a destination has taken, and its committed batches, from its checkpoint."""
        at = f"{self.root}/checkpoints/{name}"
        batches = [int(n) for n in self.files.names(f"{at}/commits") if n.isdigit()]
        # the source's log numbers its own batches; a committed batch's offset says how far it had come
        last = -1
        if batches:
            offset = self.files.read(f"{at}/offsets/{max(batches)}").splitlines()[-1]
            last = json.loads(offset).get("logOffset", -1)
        taken = set()
        for n in self.files.names(f"{at}/sources/0"):
            if n.partition(".")[0].isdigit() and not n.endswith(".tmp"):
                entries = map(json.loads, self.files.read(f"{at}/sources/0/{n}").splitlines()[1:])
                taken |= {e["path"].rpartition("/")[2] for e in entries if e["batchId"] <= last}
        return taken, max(batches, default=-1) + 1

    def queue_stats(self, name: str) -> QueueStats:
        taken, batches = self._acked(name)
        waiting = [size for _, file, size in self._held() if file not in taken]
        return QueueStats(len(waiting), sum(waiting), batches, self.dropped_files, self.dropped_bytes)

    def start(self, available_now: bool = False) -> None:
        """A query for each destination; a batch is the spool's next files up to bytes_per_batch (one file at least), each second."""
        self._stopping.clear()
        for name in self.destinations:
            source = self.spark.readStream.schema(LOG_SCHEMA).option("maxBytesPerTrigger", self.bytes_per_batch).option("ignoreMissingFiles", "true").parquet(f"{self.root}/spool")
            writer = source.writeStream.foreachBatch(self._sender(name)).option("checkpointLocation", f"{self.root}/checkpoints/{name}")
            self.queries[name] = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()

    def _sender(self, name: str) -> Callable[[DataFrame, int], None]:
        def send(batch: DataFrame, batch_id: int) -> None:
            attempt = 0
            while True:
                try:
                    self.destinations[name](batch, batch_id)
                    self.stats[name].sent += 1
                    return
                except Rejected:
                    batch.write.mode("append").parquet(f"{self.root}/dead-letter/{name}")
                    self.stats[name].rejected += 1
                    return
                except Exception as why:
                    # Unavailable, and any error of the destination that isn't a rejection: it may pass
                    self.stats[name].last_error = f"{type(why).__name__}: {why}"
                    self.stats[name].retries += 1
                    if self._stopping.wait(backoff(attempt, self.least_wait, self.most_wait)):
                        raise  # the batch isn't committed: it is sent again after a restart
                    attempt += 1

        return send

    def drain(self, timeout: float | None = None) -> None:
        for q in self.queries.values():
            q.awaitTermination(timeout)

    def stop(self, timeout: float = 5.0) -> None:
        """Waits timeout seconds in all for what is pending, then stops; the rest stays in the spool."""
        until = time.monotonic() + timeout
        while time.monotonic() < until and any(q.isActive and self.queue_stats(name).pending_files for name, q in self.queries.items()):
            time.sleep(0.05)
        self._stopping.set()
        for q in self.queries.values():
            q.stop()
