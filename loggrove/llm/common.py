"""Shared plumbing: scratch tables in the cluster's shared folder, texts in byte-bounded pieces, connected components."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker holds in one piece of vectorised work (a longer single text is a piece of its own).
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share; it is deleted when the application ends.

    Where that setting is missing, a temporary folder serves a local master (tests); on a cluster it would be one machine's, so that raises.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loggrove-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    at = f"{base.rstrip('/')}/loggrove-{context.applicationId}"
    if _FOLDERS.get(at) is None:
        path = context._jvm.org.apache.hadoop.fs.Path(at)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[at] = at
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors, and is planned by its real size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that are broadcast by join_spread at most, and rows of a key below which it never counts as frequent.
FREQUENT_KEYS, FREQUENT_ROWS = 1000, 1000


def frequent_limit(rows: int | None) -> float:
    """Rows of a key beyond which it is frequent, out of so many rows; fewer than FREQUENT_KEYS keys can be."""
    return max(FREQUENT_ROWS, (rows or 0) / FREQUENT_KEYS)


def join_spread(rows: DataFrame, unique: DataFrame, on: str, n: str = "n", how: str = "inner", limit: float | None = None) -> DataFrame:
    """rows joined with unique (one row for each key, n: how many rows have it) without shuffling a frequent key into one task.

    A key with more than 1 / FREQUENT_KEYS of all rows is frequent; there are fewer than FREQUENT_KEYS of those, so they may be
    broadcast, whatever the data. All other keys are joined by a shuffle. Both tables should be stored ones: they are read twice.
    how: inner or left. limit: frequent_limit() of the rows, where it is known.
    """
    if limit is None:
        top = unique.agg(F.sum(n).alias("all"), F.max(n).alias("most")).first()
        limit = frequent_limit(top["all"])
        if (top["most"] or 0) <= limit:
            return rows.join(unique, on, how)
    frequent = unique.where(F.col(n) > limit)
    hot = rows.join(F.broadcast(frequent), on)
    cold = rows.join(F.broadcast(frequent.select(on)), on, "left_anti").join(unique.where(F.col(n) <= limit), on, how)
    return hot.unionByName(cold)


def join_salted(rows: DataFrame, table: DataFrame, on: str, by: str, frequent: DataFrame, limit: float) -> DataFrame:
    """rows joined with table (one row for each key, of any size) without sending a frequent key of rows to one task.

    frequent: a stored table of the keys (and n, their rows) with more than limit rows, which is frequent_limit() of a table
    that holds each row or more. Such a key is split by a hash of column `by` into as many parts as keep each below the limit,
    and its row of table is repeated for each part. Only keys and numbers of parts are broadcast.
    """
    frequent = F.broadcast(frequent.select(on, F.ceil(F.col("n") / limit).cast("int").alias("__parts")))
    parts_ = F.coalesce("__parts", F.lit(1))
    left = rows.join(frequent, on, "left").withColumn("__salt", F.pmod(F.xxhash64(by), parts_).cast("int")).drop("__parts")
    right = table.join(frequent, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts_ - 1))).drop("__parts")
    return left.join(right, [on, "__salt"]).drop("__salt")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string, never null): all that an operator reads of its input, so extra columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def packed(docs: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """The columns of docs (less some) as one struct, so that no name of theirs can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in but])


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts have about limit bytes at most."""
    size, first = 0, 0
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        n = n or 0
        if i > first and size + n > limit:
            yield batch.slice(first, i - first)
            size, first = 0, i
        size += n
    if len(lengths) > first:
        yield batch.slice(first)


def release() -> None:
    """Returns what this process has freed to the system, where its C library can; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work, with release() at its end: an executor keeps its idle workers, while its JVM needs the memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


#: Edges that one task unites (each at most two nodes of some 16 bytes).
ONE_TASK_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's edges (u, v): an edge (node, smallest node of its tree) for each node but the smallest."""
    parent: dict = {}
    names = None
    for batch in batches:
        names = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            roots = []
            for x in (a, b):
                r = x
                while (up := parent.setdefault(r, r)) != r:
                    r = up
                while parent[x] != r:
                    parent[x], x = r, parent[x]
                roots.append(r)
            low, high = min(roots), max(roots)
            parent[high] = low
        if len(parent) > 2 * ONE_TASK_EDGES:  # bounded memory: what is known so far goes out as it is
            yield from _edges(parent, names)
            parent = {}
    if parent:
        yield from _edges(parent, names)


def _edges(parent: dict, names: pa.Schema) -> Iterator[pa.RecordBatch]:
    u, v = [], []
    for x in parent:
        r = x
        while parent[r] != r:
            r = parent[r]
        if r != x:
            u.append(x), v.append(r)
    yield pa.RecordBatch.from_arrays([pa.array(u, names.field(0).type), pa.array(v, names.field(1).type)], schema=names)


def components(edges: DataFrame, name: str, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component): component is the smallest node that is reachable from node; only nodes of edges (a, b) appear.

    Each task first turns its edges into a spanning forest, without a shuffle. If one_task_edges or fewer are left in all, one
    task unites them. Otherwise large-star and small-star rounds follow until nothing changes: each shuffles a row for each
    edge, keeps no list of a node's neighbours (a minimum, aggregated map-side first, replaces it), spreads the rows of a hub,
    and the edge table is written between rounds. Both ways give the same result.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    now = stored(now.mapInArrow(_forest, now.schema), f"{name}-edges")
    if now.count() <= one_task_edges:
        now = stored(now.repartition(1).mapInArrow(_forest, now.schema), f"{name}-united")
    else:
        now = _rounds(now, name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _rounds(now: DataFrame, name: str) -> DataFrame:
    for k in itertools.count():
        both = stored(now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), f"{name}-both-{k}")
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), f"{name}-low-{k}")
        large = join_spread(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), f"{name}-large-{k}")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{name}-least-{k}")
        small = join_spread(large, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, stored(small, f"{name}-{k}")
        if now.count() == before.count() and now.exceptAll(before).isEmpty():
            return now
