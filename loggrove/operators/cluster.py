"""Several tables as one: rows are routed to roots, a query asks all of them."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.query import Query
from ..plans.stats import SearchStats
from ..schema import LOG_SCHEMA, normalise
from ..sources.manifest import Files, Manifest, unreachable
from ..sources.table import Answer, LogStorage, LogTable
from .routing import Policy, route

#: Seconds for which a root that couldn't be written isn't tried again; seconds that close() waits.
COOL_OFF, CLOSE = 10.0, 5.0


class NodesUnavailable(RuntimeError):
    def __init__(self, roots: list[str], stats: SearchStats):
        super().__init__(f"unavailable: {', '.join(roots)}")
        self.stats = stats


class ClusterTable(LogStorage):
    """A strict query fails if a root is down; one that allows partial answers says that it is partial. Never silently less.

    A root is down if its table is missing or out of reach. Any other error is no reason for less: it is raised. create: make
    tables at the roots; by default only where none of them has one, so a root that is lost isn't made anew. staging: a folder
    that all roots' writers reach, for rows between add_rows() and flush(); by default below spark.checkpoint.dir, or else
    below the first root's parent. options are those of LogTable.
    """

    def __init__(self, spark: SparkSession, roots: list[str], policy: Policy = Policy.HYBRID, threshold: int = 1000, create: bool | None = None, cool_off: float = COOL_OFF, staging: str | None = None, **options):
        self.spark, self.cool_off = spark, cool_off
        self.policy, self.threshold = policy, threshold
        if create is None:
            create = not any(Manifest.versions(Files(spark, r), r.rstrip("/")) for r in roots)
        self.nodes = [LogTable(spark, r, create=create, **options) for r in roots]
        base = staging or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or roots[0].rstrip("/").rpartition("/")[0]
        self.staging, self.files = f"{base.rstrip('/')}/loggrove-staged-{uuid.uuid4().hex}", Files(spark, base)
        #: Rows that went to another root than their route says, and rows that each root has taken.
        self.rerouted, self.rows_of = 0, [0] * len(roots)
        self._shut: dict[int, float] = {}  # until when a root isn't tried
        self._staged: list[str] = []

    # writing

    def add_rows(self, rows: DataFrame) -> None:
        """Routes rows once and stages them by node: they are written at flush(), and a route drawn at random must not be drawn again."""
        at = f"{self.staging}/{uuid.uuid4().hex}"
        route(normalise(rows), len(self.nodes), self.policy, threshold=self.threshold).write.partitionBy("node").option("compression", "zstd").parquet(at)
        self._staged.append(at)

    def flush(self) -> None:
        """Writes what is staged to its roots, all at once. Rows of a root that is down, or fails on the way, are spread over the others.

        A root that fails so isn't tried again for cool_off seconds. If no root is left, what hasn't been written stays staged. A
        batch is at each moment staged for one root only, so it is written once, unless a root fails after it has published.
        """
        for at in list(self._staged):
            while waiting := [int(n[5:]) for n in self.files.names(at) if n.startswith("node=")]:
                up = self.up()
                if not up:
                    raise NodesUnavailable([n.root for n in self.nodes], SearchStats(nodes_queried=len(self.nodes), nodes_failed=len(self.nodes)))
                for k in [k for k in waiting if k not in up]:
                    self._reroute(at, k, up)
                there = [k for k in up if self.files.exists(f"{at}/node={k}")]
                with ThreadPoolExecutor(max(1, len(there))) as pool:  # each is a few small jobs that leave most executors idle
                    list(pool.map(lambda k: self._send(at, k), there))
            self.files.delete(at)
            self._staged.remove(at)

    def _batch(self, at: str, k: int) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{at}/node={k}")

    def _send(self, at: str, k: int) -> None:
        node, batch = self.nodes[k], self._batch(at, k)
        try:
            node.add_rows(batch)
            node.flush()
        except Exception as why:
            node.drop_waiting()
            if not unreachable(why) or self._manifest(k):
                raise
            self._shut[k] = time.monotonic() + self.cool_off
            return
        self.rows_of[k] += batch.count()
        self.files.delete(f"{at}/node={k}")

    def _reroute(self, at: str, k: int, up: list[int]) -> None:
        """Stages the rows of root k for the others instead, evenly."""
        batch = self._batch(at, k)
        self.rerouted += batch.count()
        other = F.element_at(F.array(*map(F.lit, up)), (F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(k)), F.lit(len(up))) + 1).cast("int"))
        batch.withColumn("node", other).write.partitionBy("node").mode("append").option("compression", "zstd").parquet(at)
        self.files.delete(f"{at}/node={k}")

    # which roots are there

    def _manifest(self, k: int) -> bool:
        """Whether root k can be reached. A table that is there but wrong (another format) is an error."""
        if getattr(self.nodes[k], "down", False):
            return False
        try:
            self.nodes[k].manifest()
            return True
        except Exception as why:
            if unreachable(why):
                return False
            raise

    def available(self, k: int) -> bool:
        return self._shut.get(k, 0.0) <= time.monotonic() and self._manifest(k)

    def up(self) -> list[int]:
        """Roots that can be written."""
        return [k for k in range(len(self.nodes)) if self.available(k)]

    # reading

    def ask(self, query: Query) -> Answer:
        """Each root gives its own first rows, their union the first of all. A root that fails while it is planned counts as down only if it can't be reached."""

        def one(k: int) -> Answer | None:
            if not self._manifest(k):
                return None
            try:
                return self.nodes[k].ask(query)
            except Exception as why:
                if not unreachable(why) or self._manifest(k):
                    raise
                return None

        with ThreadPoolExecutor(len(self.nodes)) as pool:  # planning is a small job or two for each root
            got = list(pool.map(one, range(len(self.nodes))))
        answers, failed = [a for a in got if a], [k for k, a in enumerate(got) if a is None]
        down = SearchStats(nodes_queried=len(failed), nodes_failed=len(failed))
        stats = reduce(SearchStats.merge, [a.stats for a in answers], down)
        if failed and (not answers or not query.allow_partial):
            raise NodesUnavailable([self.nodes[k].root for k in failed], stats)
        # only a limit needs an order within each root
        if query.limit <= 0:
            return Answer.of(query, reduce(DataFrame.unionByName, [a.unordered for a in answers]), stats)
        rows = reduce(DataFrame.unionByName, [a.rows for a in answers])
        return Answer(query.first(rows), stats, tuple(o for a in answers if a.stats.blocks_scanned for o in a.seen))

    def explain(self, query: Query) -> SearchStats:
        """What the roots that are up count, and how many are down."""
        up = [k for k in range(len(self.nodes)) if self._manifest(k)]
        down = len(self.nodes) - len(up)
        return reduce(SearchStats.merge, [self.nodes[k].explain(query) for k in up], SearchStats(nodes_queried=down, nodes_failed=down))

    def close(self, timeout: float = CLOSE) -> None:
        """Flushes for timeout seconds at most. What isn't written by then stays staged, and TimeoutError says so."""
        pool = ThreadPoolExecutor(1)
        try:
            pool.submit(self.flush).result(timeout)
        except Late as why:
            raise TimeoutError(f"rows are still staged at {self.staging}") from why
        finally:
            pool.shutdown(wait=False)
