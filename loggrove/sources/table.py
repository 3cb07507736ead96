"""The log table: day and shard partitions, rows sorted by stream and time, block heads, a token index, a manifest.

Layout under a root: data, heads and index /part=NAME/day=D/shard=S, manifest/vN.json. A part is live if the manifest names it;
anything else is left over from a crash and is ignored until vacuum() deletes it. A shard holds a part of the streams, so a
query for one stream opens one of them. Fields that the table's creator names are columns of their own in the data files; the
others are a map. A block's head holds its number of rows, its time range, its size, and the fields that are constant in it;
heads and the index alone tell which blocks a query needs, without a look at the data.
"""

from __future__ import annotations

import time
import uuid
from abc import ABC, abstractmethod
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.streams import sticky
from ..functions.tokens import distinct_tokens, has_token
from ..plans.query import Query
from ..plans.stats import GlobalStats, SearchStats
from ..schema import BLOCK_ROWS, LOG_SCHEMA, day_of, logical_bytes, normalise, unsigned
from . import jsonrows
from .manifest import Conflict, Files, Manifest, Part

PLACE = [T.StructField("part", T.StringType()), T.StructField("day", T.LongType()), T.StructField("shard", T.IntegerType())]
INDEX = T.StructType([T.StructField("name", T.StringType()), T.StructField("token", T.StringType()), T.StructField("stream_id", T.LongType()), T.StructField("block", T.LongType()), *PLACE])
HEADS = T.StructType([*[T.StructField(n, T.LongType()) for n in ("stream_id", "block", "n", "lo", "hi", "size")], T.StructField("consts", T.MapType(T.StringType(), T.StringType())), *PLACE])
KEYS = ["part", "day", "shard", "stream_id", "block"]
#: Parts of a day and shard from which a flush merges them; added batches that wait for a flush at most.
MERGE_PARTS, MOST_WAITING = 8, 64
#: Seconds for which files of parts that were merged or dropped stay, for searches that have begun.
KEEP_SECONDS = 3600
#: Blocks up to which their list is broadcast to the scan (some 40 bytes each), and their share of all from which it isn't joined.
FEW_BLOCKS, MOST_BLOCKS = 100_000, 0.5


class LogStorage(ABC):
    """What every store offers."""

    @abstractmethod
    def add_rows(self, rows: DataFrame) -> None: ...

    @abstractmethod
    def flush(self) -> None: ...

    @abstractmethod
    def ask(self, query: Query) -> Answer: ...

    @abstractmethod
    def explain(self, query: Query) -> SearchStats: ...

    def search(self, query: Query) -> DataFrame:
        """Matching rows in canonical order, the first `limit` if there is one."""
        return self.ask(query).rows

    def insert_json(self, texts: DataFrame, column: str = "value") -> None:
        """Adds rows from JSON texts (an object or an array of them); a text that isn't valid fails the flush as a whole."""
        self.add_rows(jsonrows.parse(texts, column))

    def select_json(self, query: str) -> tuple[DataFrame, SearchStats]:
        """A search whose query and rows are JSON: rows in canonical order (column value), and what explain() counts."""
        asked = Query.from_json(query)
        return jsonrows.render(self.search(asked)), self.explain(asked)

    @abstractmethod
    def close(self) -> None: ...

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


@dataclass
class Answer:
    """Rows of a search, and what it opens and skips. run() reads the rows once and completes the statistics from that reading.

    unordered: the rows that match, without order and limit, each with the number of its block.
    """

    rows: DataFrame
    stats: SearchStats
    seen: tuple[Observation, ...] = ()
    unordered: DataFrame | None = None

    @staticmethod
    def of(query: Query, unordered: DataFrame, stats: SearchStats) -> Answer:
        """Counts what matches: before a limit, but behind a sort without one, for a sort reads its input twice."""
        seen = Observation()
        counted = lambda rows: rows.observe(seen, F.count("*").alias("n"), F.approx_count_distinct("block", 0.01).alias("blocks"))
        rows = query.first(counted(unordered)) if query.limit > 0 else counted(query.first(unordered))
        return Answer(rows.select("ts_ns", "stream_id", "fields"), stats, (seen,), unordered)

    @property
    def is_partial(self) -> bool:
        return self.stats.is_partial

    def run(self, action: Callable[[DataFrame], Any] = DataFrame.collect) -> tuple[Any, SearchStats]:
        """What action makes of the rows (it must read them), and the statistics with the numbers of rows and blocks that matched (blocks: about)."""
        out = action(self.rows)
        if self.stats.blocks_scanned:
            got = [o.get for o in self.seen]
            self.stats.rows_matched = sum(g["n"] for g in got)
            self.stats.token_true = min(self.stats.token_maybe, sum(g["blocks"] for g in got)) if self.stats.token_maybe else 0
        return out, self.stats


class LogTable(LogStorage):
    """create: make a new table where there is none (else a missing one is an error). shards and columns are those of the creation."""

    def __init__(self, spark: SparkSession, root: str, block_rows: int = BLOCK_ROWS, merge_parts: int = MERGE_PARTS, retention_days: int = 0, index: bool = True, shards: int = 1, columns: tuple[str, ...] = (), create: bool = True, most_waiting: int = MOST_WAITING, keep_seconds: float = KEEP_SECONDS):
        self.spark, self.root, self.block_rows, self.merge_parts, self.retention_days, self.index = spark, root.rstrip("/"), block_rows, merge_parts, retention_days, index
        self.most_waiting, self.keep_seconds = most_waiting, keep_seconds
        self.files = Files(spark, root)
        self.stats = GlobalStats()
        self._waiting: list[DataFrame] = []
        if create and not Manifest.versions(self.files, self.root):
            try:
                Manifest(shards=shards, columns=tuple(columns)).save(self.files, self.root, [], version=0)
            except Conflict:
                pass  # another one has just created it

    # writing

    def add_rows(self, rows: DataFrame) -> None:
        """Takes rows; they can be searched after flush(), which comes by itself before more than most_waiting batches wait."""
        if len(self._waiting) >= self.most_waiting:
            self.flush()
        self._waiting.append(normalise(rows))

    def flush(self) -> None:
        """Writes what has been added as one part for each day and shard, and publishes all of them at once. Merges days of many parts.

        If that fails, nothing is published and all of it goes on waiting; drop_waiting() gives it up.
        """
        waiting = list(self._waiting)
        if not waiting:
            return
        new = self._write(reduce(DataFrame.unionByName, waiting))
        self._publish(lambda parts: [*parts, *new])
        self._waiting = self._waiting[len(waiting) :]
        self.stats.logical_bytes += sum(p.logical_bytes for p in new)
        written = sum(self.files.bytes(self._at("data", p)) for p in new)
        self.stats.bytes_flushed += written
        self.stats.bytes_written += written
        self.stats.rows_added += sum(p.rows for p in new)
        if self.merge_parts:
            places = [(p.day, p.shard) for p in self.manifest().parts]
            if many := sorted({d for (d, _), n in Counter(places).items() if n >= self.merge_parts}):
                self.compact(*many)

    def drop_waiting(self) -> int:
        """Gives up what waits for a flush; returns the number of batches."""
        n, self._waiting = len(self._waiting), []
        return n

    def _at(self, kind: str, part: Part) -> str:
        return f"{self.root}/{kind}/{part.at}"

    def _stored(self, rows: DataFrame, kind: str, name: str, **options: str) -> None:
        rows.write.partitionBy("day", "shard").option("compression", "zstd").options(**options).parquet(f"{self.root}/{kind}/part={name}")

    def _write(self, rows: DataFrame) -> list[Part]:
        name, table = uuid.uuid4().hex, self.manifest()
        fields = F.col("fields")
        own = [fields[c].alias(f"f_{c}") for c in table.columns]
        rest = F.map_filter(fields, lambda k, v: ~k.isin(*table.columns)).alias("fields") if own else fields
        rows = rows.select("ts_ns", "stream_id", rest, *own).withColumn("day", day_of(F.col("ts_ns"))).withColumn("shard", sticky(F.col("stream_id"), table.shards))
        # ranges of (day, shard, stream, time): a hot stream spreads over tasks, and each file covers few streams
        keys = [F.col("day"), F.col("shard"), unsigned(F.col("stream_id")), F.col("ts_ns")]
        placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        # a block: rows of one stream among block_rows that follow each other in a file
        placed = placed.withColumn("block", F.call_function("div", F.monotonically_increasing_id(), F.lit(self.block_rows)))
        # the second version of Parquet's pages, and no dictionary, make differences of the sorted times
        delta = {"parquet.block.size": str(32 << 20), "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#ts_ns": "false", "parquet.enable.dictionary#block": "false"}
        self._stored(placed, "data", name, **delta)
        places = self._places("data", name)
        if not places:
            return []
        made = [Part(name, d, 0, 0, 0, 0, False, 0, s) for d, s in places]
        written = self._rows(made)
        self._stored(self._heads(written), "heads", name)
        if self.index:
            self._write_index(written, self._read("heads", HEADS, made), name)
        tokens = set(self._places("index", name))  # where all fields are constant there are none
        heads = self._read("heads", HEADS, made).groupBy("day", "shard").agg(F.sum("n").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("blocks"), F.sum("size").alias("size")).collect()
        return [Part(name, r.day, r.rows, r.blocks, r.lo, r.hi, self.index, r.size, r.shard, (r.day, r.shard) in tokens) for r in heads]

    def _places(self, kind: str, name: str) -> list[tuple[int, int]]:
        """Days and shards of a part's files."""
        at = f"{self.root}/{kind}/part={name}"
        return sorted((int(d[4:]), int(s[6:])) for d in self.files.names(at) if d.startswith("day=") for s in self.files.names(f"{at}/{d}") if s.startswith("shard="))

    def _heads(self, written: DataFrame) -> DataFrame:
        """A row for each block. Constant: a field with one value, which isn't empty, in all rows."""
        keys = ["day", "shard", "stream_id", "block"]
        heads = written.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi"), F.sum(logical_bytes()).alias("size"))
        each = written.select(*keys, F.explode("fields").alias("name", "value")).groupBy(*keys, "name").agg(F.min("value").alias("v"), F.max("value").alias("w"), F.count("*").alias("k"))
        consts = each.where("v = w").join(heads.select(*keys, "n"), keys).where("k = n").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("consts"))
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        return heads.join(consts, keys, "left").withColumn("consts", F.coalesce("consts", none)).repartitionByRange("day", "shard", "stream_id").sortWithinPartitions("day", "shard", "stream_id", "block")

    def _write_index(self, written: DataFrame, heads: DataFrame, name: str) -> None:
        """Distinct tokens of each block and field that isn't constant in it, sorted by token, with a bloom filter: a lookup is an equality that Parquet itself skips by."""
        keys = ["day", "shard", "stream_id", "block"]
        each = written.select(*keys, F.explode("fields").alias("name", "value"))
        known = heads.select(*keys, F.explode(F.map_keys("consts")).alias("name"))
        tokens = each.join(known, [*keys, "name"], "left_anti").select(*keys, "name", F.explode(distinct_tokens("value")).alias("token")).distinct()
        # ranges, not days: one day may be most of a flush, and a file that covers few tokens is skipped by its footer
        by = ["day", "shard", "name", "token"]
        self._stored(tokens.repartitionByRange(*by).sortWithinPartitions(*by), "index", name, **{"parquet.bloom.filter.enabled#token": "true"})

    def _publish(self, change, gone: tuple[Part, ...] = ()) -> None:
        """Publishes changed parts. Files of parts that are gone are deleted by the first change that comes keep_seconds later, or by vacuum()."""
        for _ in range(20):
            now, clock = self.manifest(), int(1000 * time.time())
            left = [*now.gone, *((p.at, clock) for p in gone)]
            over = [p for p, t in left if t <= clock - 1000 * self.keep_seconds]
            try:
                now.save(self.files, self.root, change(list(now.parts)), [g for g in left if g[0] not in over])
            except Conflict:  # another writer was first: its version is the base now
                continue
            for place in over:
                self._delete(place)
            return
        raise Conflict(self.root)

    # maintenance

    def compact(self, *days: int) -> None:
        """Rewrites the parts of these days (of every day, if none is given) as one for each day and shard: one job and one change of the manifest. A search that has begun goes on."""
        live = self.manifest().parts
        every = Counter((p.day, p.shard) for p in live if not days or p.day in days)
        old = [p for p in live if every[p.day, p.shard] > 1]
        if not old:
            return
        new = self._write(self._rows(old))
        self.stats.bytes_written += sum(self.files.bytes(self._at("data", p)) for p in new)
        merged = {p.at for p in old}

        def swap(parts: list[Part]) -> list[Part]:
            if not merged <= {p.at for p in parts}:
                raise RuntimeError("parts were merged or dropped meanwhile")
            return [p for p in parts if p.at not in merged] + new

        self._publish(swap, tuple(old))

    def _delete(self, place: str) -> None:
        for kind in ("data", "heads", "index"):
            self.files.delete(f"{self.root}/{kind}/{place}")

    def drop_before(self, day: int) -> None:
        """Retention: drops whole days before day."""
        old = [p for p in self.manifest().parts if p.day < day]
        if old:
            self._publish(lambda parts: [p for p in parts if p.day >= day], tuple(old))

    def enforce_retention(self, now_ns: int) -> None:
        if self.retention_days:
            self.drop_before(now_ns // 86_400_000_000_000 - self.retention_days)

    def vacuum(self, keep_seconds: float | None = None) -> int:
        """Deletes what the manifest doesn't name and hasn't changed for keep_seconds (the table's): parts, and days and shards of live parts. Returns their number.

        A part that another writer is about to publish is younger than that.
        """
        keep = self.keep_seconds if keep_seconds is None else keep_seconds
        before = 1000 * (time.time() - keep)
        live = {p.at for p in self.manifest().parts}
        count = 0
        for part, changed in self.files.ages(f"{self.root}/data"):
            if not part.startswith("part="):
                continue
            if not any(p.startswith(f"{part}/") for p in live):
                if changed <= before:
                    self._delete(part)
                    count += 1
                continue
            for day in [n for n in self.files.names(f"{self.root}/data/{part}") if n.startswith("day=")]:
                for shard, at in self.files.ages(f"{self.root}/data/{part}/{day}"):
                    if shard.startswith("shard=") and f"{part}/{day}/{shard}" not in live and at <= before:
                        self._delete(f"{part}/{day}/{shard}")
                        count += 1
        return count

    def partition_days(self) -> list[int]:
        return sorted({p.day for p in self.manifest().parts})

    def close(self) -> None:
        self.flush()

    # reading

    def manifest(self) -> Manifest:
        return Manifest.load(self.files, self.root)

    def _read(self, kind: str, schema: T.StructType, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*[self._at(kind, p) for p in parts])

    def _raw(self, parts: list[Part]) -> DataFrame:
        own = [T.StructField(f"f_{c}", T.StringType()) for c in self.manifest().columns]
        return self._read("data", T.StructType([*LOG_SCHEMA.fields, *own, T.StructField("block", T.LongType()), *PLACE]), parts)

    def _whole(self, raw: DataFrame) -> Column:
        """All fields of a row again, from its map and its own columns."""
        names = [c[2:] for c in raw.columns if c.startswith("f_")]
        if not names:
            return F.col("fields")
        each = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"`f_{n}`").alias("value")) for n in names]), lambda e: e["value"].isNotNull())
        return F.map_concat("fields", F.map_from_entries(each)).alias("fields")

    def _rows(self, parts: list[Part]) -> DataFrame:
        raw = self._raw(parts)
        return raw.select("ts_ns", "stream_id", self._whole(raw), "block", "part", "day", "shard")

    def scan(self) -> DataFrame:
        """All live rows."""
        return self._rows(list(self.manifest().parts))

    def _pruned(self, query: Query) -> tuple[list[Part], list[Part]]:
        """All parts, and those that may hold what is asked for, by time and by the stream's shard."""
        table = self.manifest()
        live = list(table.parts)
        shard = None if query.stream_id is None else query.shard(table.shards)
        return live, [p for p in live if p.min_ts <= query.max_ts and p.max_ts >= query.min_ts and shard in (None, p.shard)]

    def candidates(self, query: Query, parts: list[Part]) -> DataFrame | None:
        """Heads of the blocks that can hold a row of the query: by time, stream, constant fields, and the index where a field isn't constant.

        None where a part has no index and the query has filters.
        """
        if query.filters and not all(p.indexed for p in parts):
            return None
        heads = self._read("heads", HEADS, parts).where((F.col("lo") <= query.max_ts) & (F.col("hi") >= query.min_ts)).where(query.predicate_stream())
        for f in query.filters:
            const = F.col("consts")[f.column]
            heads = heads.where(const.isNull() | has_token(const, f.token))
        if query.filters:
            index = self._read("index", INDEX, [p for p in parts if p.tokens]).where(query.predicate_stream())
            for k, f in enumerate(query.filters):
                hit = index.where((F.col("name") == f.column) & (F.col("token") == f.token)).select(*KEYS, F.lit(True).alias(f"hit_{k}"))
                heads = heads.join(hit, KEYS, "left").where(F.col("consts")[f.column].isNotNull() | F.coalesce(f"hit_{k}", F.lit(False))).drop(f"hit_{k}")
        return heads

    def matching(self, query: Query) -> DataFrame:
        """Rows that match, in no order."""
        return self._matching(query)[0]

    def _matching(self, query: Query) -> tuple[DataFrame, SearchStats]:
        """Rows that match (with their blocks), and what is opened for them. Parts by time and shard, then blocks by heads and index; the whole predicate last, so an index can't add a row.

        The list of blocks is counted first: a few are broadcast; where it holds most of them the join is left out, for it would save nothing.
        """
        live, parts = self._pruned(query)
        raw = self._raw(parts)
        stats = self._planned(query, live, parts)
        heads = self.candidates(query, parts)
        all_blocks = sum(p.blocks for p in parts)
        if heads is not None and parts and stats.blocks_scanned < MOST_BLOCKS * all_blocks:
            blocks = heads.select(*KEYS)
            raw = raw.join(F.broadcast(blocks) if stats.blocks_scanned <= FEW_BLOCKS else blocks, KEYS, "left_semi")
        own = {c[2:]: F.col(f"`{c}`") for c in raw.columns if c.startswith("f_")}
        return raw.where(query.predicate(with_day=True, own=own)).select("ts_ns", "stream_id", self._whole(raw), *[c for c in KEYS if c != "stream_id"]), stats

    def ask(self, query: Query) -> Answer:
        rows, stats = self._matching(query)
        return Answer.of(query, rows.select("ts_ns", "stream_id", "fields", F.xxhash64(*KEYS).alias("block")), stats)

    def _planned(self, query: Query, live: list[Part], parts: list[Part]) -> SearchStats:
        """What heads and index say: no row is read."""
        total = sum(p.blocks for p in live)
        stats = SearchStats(len({(p.day, p.shard) for p in live}), len({(p.day, p.shard) for p in parts}), len(live), len(parts), total, nodes_queried=1, bytes_opened=sum(self.files.bytes(self._at("data", p)) for p in parts))
        if not parts:
            stats.blocks_skipped_by_time = total
            return stats
        in_time = (F.col("lo") <= query.max_ts) & (F.col("hi") >= query.min_ts)
        of = lambda condition, value=F.lit(1): F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")
        # blocks of parts that the stream's shard rules out are skipped by stream
        shut = sum(p.blocks for p in live if p.min_ts <= query.max_ts and p.max_ts >= query.min_ts) - sum(p.blocks for p in parts)
        c = self._read("heads", HEADS, parts).agg(of(in_time).alias("t"), of(in_time & query.predicate_stream()).alias("s"), of(in_time & query.predicate_stream(), F.col("n")).alias("rows")).first()
        heads = self.candidates(query, parts) if query.filters else None
        left = (c.s, c.rows) if heads is None else tuple(heads.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first())
        stats.blocks_skipped_by_time = total - shut - c.t
        stats.blocks_skipped_by_stream = shut + c.t - c.s
        stats.blocks_skipped_by_token = c.s - left[0]
        stats.blocks_scanned, stats.rows_scanned = left
        stats.token_maybe = left[0] if query.filters else 0
        return stats

    def explain(self, query: Query) -> SearchStats:
        """What search() opens, skips and finds, exactly: from heads and index, and one reading of the blocks that are left."""
        rows, stats = self._matching(query)
        hits = rows.groupBy(*KEYS).agg(F.count("*").alias("n")).agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        stats.rows_matched = hits.n
        stats.token_true = hits.blocks if query.filters else 0
        return stats
