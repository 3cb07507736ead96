"""Contract queries over the test tables, each beside the SQL that DuckDB answers with the same rows.

documents as logs: stream = source, _msg = text. events as logs: stream = user_id, time = ts, fields event_type, value, props.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.streams import sticky, with_stream_id
from .functions.tokens import distinct_tokens, has_token, tokens
from .operators import blocks
from .operators.cluster import ClusterTable, NodesUnavailable
from .operators.routing import Policy, balance, predicted_ratio, route
from .plans.query import Filter, Query
from .plans.stats import SearchStats
from .sources import jsonrows, wire
from .sources.generate import COMMON, RARE, absent_tokens, generate
from .sources.table import LogTable
from .streaming.forward import Forwarder, Rejected, Unavailable, backoff

DAY_US = 86_400_000_000
W = "[A-Za-z0-9]+"
QUERIES, SQL = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents")


def events(spark, d):
    return table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def day(us="us"):
    return F.floor(F.col(us) / DAY_US).cast("long")


US = "epoch_us(ts)"


@query(f"SELECT doc_id, source FROM documents WHERE list_contains(regexp_extract_all(text, '{W}'), 'the') ORDER BY source, doc_id LIMIT 100")
def flagship(spark, d):
    return docs(spark, d).where(has_token("text", "the")).select("doc_id", "source").orderBy("source", "doc_id").limit(100)


def _by_token(name: str, token: str):
    def f(spark, d):
        return docs(spark, d).where(has_token("text", token)).select("doc_id")

    f.__name__ = name
    query(f"SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(text, '{W}'), '{token}')")(f)


for _name, _token in (("token_filter", "the"), ("token_case", "The"), ("token_absent", "nonexistent0123456789abcdef"), ("token_with_separator", "the of")):
    _by_token(_name, _token)


@query(f"SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(text, '{W}'), 'the') AND list_contains(regexp_extract_all(text, '{W}'), 'of')")
def token_conj(spark, d):
    return docs(spark, d).where(has_token("text", "the") & has_token("text", "of")).select("doc_id")


@query(f"SELECT count(*) AS n_substring, CAST(sum(CASE WHEN list_contains(regexp_extract_all(text, '{W}'), 'th') THEN 1 ELSE 0 END) AS BIGINT) AS n_token FROM documents WHERE contains(text, 'th')")
def token_substring(spark, d):
    return docs(spark, d).where(F.col("text").contains("th")).agg(F.count("*").alias("n_substring"), F.sum(has_token("text", "th").cast("long")).alias("n_token"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{W}')) AS token FROM documents) GROUP BY token")
def tokenize(spark, d):
    return docs(spark, d).select(F.explode(tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '{W}'))) AS INTEGER) AS n FROM documents")
def token_distinct(spark, d):
    return docs(spark, d).select("doc_id", F.size(distinct_tokens("text")).alias("n"))




def at(us: int):
    """A literal of the column ts, which Parquet's statistics can be compared with."""
    return F.expr(f"TIMESTAMP_NTZ'{datetime(1970, 1, 1) + timedelta(microseconds=us)}'")


@query(f"SELECT event_id, user_id FROM events WHERE {US} BETWEEN 1704153600000000 AND 1705363200000000")
def time_range(spark, d):
    return table(spark, d, "events").where(F.col("ts").between(at(1704153600000000), at(1705363200000000))).select("event_id", "user_id")


@query(f"SELECT event_id FROM events WHERE {US} >= (SELECT min({US}) FROM events) AND {US} <= (SELECT min({US}) FROM events)")
def time_range_edge(spark, d):
    own = table(spark, d, "events")
    return own.where(F.col("ts") == own.agg(F.min("ts")).scalar()).select("event_id")


@query("SELECT event_id, event_type FROM events WHERE user_id = 7")
def stream_filter(spark, d):
    return table(spark, d, "events").where("user_id = 7").select("event_id", "event_type")


@query(f"SELECT event_id FROM events WHERE user_id < 50 AND {US} BETWEEN 1704153600000000 AND 1706659200000000 AND list_contains(regexp_extract_all(event_type, '{W}'), 'click')")
def stream_time_token(spark, d):
    return table(spark, d, "events").where((F.col("user_id") < 50) & F.col("ts").between(at(1704153600000000), at(1706659200000000)) & has_token("event_type", "click")).select("event_id")


@query("SELECT event_id, user_id, ts FROM events ORDER BY user_id, ts, event_id LIMIT 100")
def limit_first_n(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts").orderBy("user_id", "ts", "event_id").limit(100)


@query(f"SELECT CAST(floor({US} / 86400000000) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1")
def day_histogram(spark, d):
    return events(spark, d).groupBy(day().alias("day")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS BIGINT) AS block FROM events")
def block_cut(spark, d):
    return blocks.cut(table(spark, d, "events"), "user_id", ["ts", "event_id"], 8).select("event_id", "block")


@query("SELECT user_id, block, count(*) AS n_rows, min(ts) AS min_ts, max(ts) AS max_ts FROM (SELECT user_id, ts, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS BIGINT) AS block FROM events) GROUP BY user_id, block")
def block_headers(spark, d):
    return blocks.headers(blocks.cut(table(spark, d, "events"), "user_id", ["ts", "event_id"], 8), ["user_id", "block"], "ts")


@query("SELECT o_custkey, coalesce(min(o_orderstatus) = max(o_orderstatus) AND count(o_orderstatus) = count(*) AND min(o_orderstatus) <> '', false) AS is_const FROM orders GROUP BY o_custkey")
def const_columns(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(blocks.is_constant("o_orderstatus").alias("is_const"))


@query("""SELECT user_id, CASE WHEN d <= 8 AND d < n AND b <= 256 THEN 'dict' WHEN num THEN 'uint64' ELSE 'string' END AS enc
FROM (SELECT user_id, count(*) AS d, sum(k) AS n, sum(strlen(v)) AS b, bool_and(regexp_full_match(v, '0|[1-9][0-9]{0,18}')) AS num
  FROM (SELECT user_id, CAST(event_id AS VARCHAR) AS v, count(*) AS k FROM events GROUP BY 1, 2) GROUP BY user_id)""")
def encoding_class(spark, d):
    values = table(spark, d, "events").select("user_id", F.col("event_id").cast("string").alias("v"))
    return blocks.encoding_class(values, ["user_id"], "v")


@query("SELECT doc_id, CAST(32 + strlen('_msg') + strlen(text) + 6 AS BIGINT) AS bytes FROM documents")
def logical_bytes(spark, d):
    from .schema import logical_bytes as size

    return docs(spark, d).select("doc_id", F.create_map(F.lit("_msg"), "text").alias("fields")).select("doc_id", size().alias("bytes"))


@query("SELECT event_id, CAST(xor(user_id, user_id >> 33) % 7 AS INTEGER) AS node FROM events")
def route_sticky(spark, d):
    return table(spark, d, "events").select("event_id", sticky(F.col("user_id").cast("long"), 7).alias("node"))


@query("""SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5 THEN CAST(xor(user_id, user_id >> 33) % 4 AS INTEGER) ELSE CAST(event_id % 4 AS INTEGER) END AS node FROM events""")
def route_hybrid(spark, d):
    own = table(spark, d, "events").withColumn("user_id", F.col("user_id").cast("long"))
    return route(own, 4, Policy.HYBRID, "user_id", ["ts", "event_id"], 5, (F.col("event_id") % 4).cast("int")).select("event_id", "node")


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS busiest, max(n) * 4 / sum(n) AS ratio FROM (SELECT xor(user_id, user_id >> 33) % 4 AS node, count(*) AS n FROM events GROUP BY 1)")
def route_balance(spark, d):
    own = table(spark, d, "events").withColumn("user_id", F.col("user_id").cast("long"))
    return balance(route(own, 4, Policy.STICKY, "user_id"), 4)


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def active_streams(spark, d):
    return table(spark, d, "events").agg(F.countDistinct("user_id").alias("n"))


@query("SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ORDER BY n DESC, user_id LIMIT 1")
def hot_stream(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(1)


# the same contract through the library's own tables, written, published and read back


def _scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share, deleted when the application ends. Where none is set: a temporary one for a local master, an error on a cluster."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loggrove-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/loggrove-{uuid.uuid4().hex}")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def event_logs(spark, d):
    """events as log rows."""
    fields = F.create_map(F.lit("event_id"), F.col("event_id").cast("string"), F.lit("event_type"), F.col("event_type"), F.lit("props"), F.col("props"))
    return events(spark, d).select((F.col("us") * 1000).alias("ts_ns"), F.col("user_id").cast("long").alias("stream_id"), fields.alias("fields"))


def _as_events(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("fields")["event_id"].cast("long").alias("event_id"), F.col("stream_id").alias("user_id"))


_MADE: dict[tuple, LogTable] = {}


def _made(spark, d, name: str, make) -> LogTable:
    """A table that several queries read; it is written once in an application."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def _written(spark, rows: DataFrame, **options) -> LogTable:
    out = LogTable(spark, _scratch(spark), **options)
    out.add_rows(rows)
    out.flush()
    return out


def _event_table(spark, d) -> LogTable:
    return _made(spark, d, "events", lambda: _written(spark, event_logs(spark, d), shards=2, columns=("event_type",), block_rows=64))


def _line_table(spark, d) -> LogTable:
    """lineitem as logs of the orders."""
    fields = F.create_map(F.lit("line"), F.col("l_linenumber").cast("string"))
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("ts_ns"), F.col("l_orderkey").alias("stream_id"), fields.alias("fields"))
    return _made(spark, d, "lines", lambda: _written(spark, rows, index=False))


def _doc_table(spark, d) -> LogTable:
    """documents as logs of their sources."""
    rows = docs(spark, d).select(F.col("doc_id").alias("ts_ns"), F.xxhash64("source").alias("stream_id"), F.create_map(F.lit("_msg"), F.col("text")).alias("fields"))
    return _made(spark, d, "documents", lambda: _written(spark, rows, block_rows=64))


def _cluster(spark, d, n: int, policy: Policy = Policy.STICKY, write: bool = True, **options) -> ClusterTable:
    root = _scratch(spark)
    own = ClusterTable(spark, [f"{root}/{k}" for k in range(n)], policy, **options)
    if write:
        own.add_rows(event_logs(spark, d))
        own.flush()
    return own


def _lose(cluster: ClusterTable, k: int) -> None:
    cluster.nodes[k].files.delete(cluster.nodes[k].root)


def _one_row(spark, **columns) -> DataFrame:
    kind = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {kind[type(v)]}" for k, v in columns.items()))


EVER = (-(2**63), 2**63 - 1)
SOME = (1704153600000000000, 1705363200000000000)
AS_EVENTS = "SELECT event_id, CAST(user_id AS BIGINT) AS user_id FROM events"
STICKY_3 = "xor(user_id, user_id >> 33) % 3"


@query(f"{AS_EVENTS} WHERE {US} BETWEEN 1704153600000000 AND 1705363200000000 AND event_type = 'click'")
def table_search(spark, d):
    return _as_events(_event_table(spark, d).search(Query(*SOME, filters=(Filter("event_type", "click"),))))


@query(f"{AS_EVENTS} WHERE user_id = 7 AND floor({US} / 86400000000) >= 19730")
def table_after_merge_and_retention(spark, d):
    own = LogTable(spark, _scratch(spark), merge_parts=0)
    for early in (True, False):
        own.add_rows(event_logs(spark, d).where((F.col("ts_ns") < SOME[1]) == early))
        own.flush()
    own.add_rows(event_logs(spark, d).where("false"))
    own.flush()
    own.compact()
    own.drop_before(19730)
    return _as_events(own.search(Query(*EVER, stream_id=7)))


@query(f"SELECT CAST(floor({US} / 86400000000) AS BIGINT) AS day, count(*) AS n, min({US}) * 1000 AS least, max({US}) * 1000 AS most FROM events GROUP BY 1")
def table_parts(spark, d):
    parts = _event_table(spark, d).manifest().parts
    each = spark.createDataFrame([(p.day, p.rows, p.min_ts, p.max_ts) for p in parts], "day long, n long, least long, most long")
    return each.groupBy("day").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


@query(f"{AS_EVENTS} WHERE event_type = 'purchase'")
def cluster_search(spark, d):
    own = _cluster(spark, d, 3, Policy.HYBRID, threshold=5)
    return _as_events(own.search(Query(*EVER, filters=(Filter("event_type", "purchase"),))))


@query(f"{AS_EVENTS} ORDER BY user_id, ts, event_id LIMIT 100")
def cluster_first_n(spark, d):
    return _as_events(_cluster(spark, d, 2, Policy.SPRAY, index=False).search(Query(*EVER, limit=100)))


@query(AS_EVENTS)
def forwarded(spark, d):
    """Through the spool and a streaming query into a table."""
    root = _scratch(spark)
    own = LogTable(spark, f"{root}/table", index=False)

    def deliver(batch: DataFrame, _: int) -> None:
        own.add_rows(batch)
        own.flush()

    forwarder = Forwarder(spark, f"{root}/agent", {"table": deliver})
    forwarder.add_rows(event_logs(spark, d))
    forwarder.start(available_now=True)
    forwarder.drain()
    return _as_events(own.scan())


@query(AS_EVENTS)
def json_rows(spark, d):
    return _as_events(jsonrows.parse(jsonrows.render(event_logs(spark, d))))


@query(AS_EVENTS)
def wire_rows(spark, d):
    return _as_events(wire.decode(wire.encode(event_logs(spark, d), 1000)))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos FROM events")
def canonical_sort(spark, d):
    """Positions within each stream of a search's rows."""
    rows = _event_table(spark, d).search(Query(*EVER)).select(F.col("fields")["event_id"].cast("long").alias("event_id"), "stream_id", "ts_ns")
    return rows.select("event_id", F.row_number().over(Window.partitionBy("stream_id").orderBy("ts_ns", "event_id")).alias("pos"))


@query("SELECT count(*) AS out_of_order FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p > ts")
def sort_oracle(spark, d):
    """Rows of the first thousand of a search that stand before a row that should precede them."""
    rows = _event_table(spark, d).search(Query(*EVER, limit=1000)).select("stream_id", "ts_ns").collect()
    return _one_row(spark, out_of_order=sum((a.stream_id % 2**64, a.ts_ns) > (b.stream_id % 2**64, b.ts_ns) for a, b in zip(rows, rows[1:])))


@query("SELECT event_id, user_id FROM events ORDER BY user_id, ts, event_id LIMIT 50")
def limit_pushdown(spark, d):
    """Each of four roots gives its own first 50 rows."""
    return _as_events(_cluster(spark, d, 4, index=False).search(Query(*EVER, limit=50)))


@query(f"SELECT DISTINCT CAST(floor({US} / 86400000000) AS BIGINT) AS day FROM events")
def partition_days(spark, d):
    return spark.createDataFrame([(x,) for x in _event_table(spark, d).partition_days()], "day long")


@query(f"{AS_EVENTS} WHERE floor({US} / 86400000000) >= 19730")
def retention(spark, d):
    own = _written(spark, event_logs(spark, d), retention_days=20, index=False)
    own.enforce_retention(19750 * 86_400_000_000_000)
    return _as_events(own.scan())


@query(AS_EVENTS)
def federated_union(spark, d):
    return _as_events(_cluster(spark, d, 3).search(Query(*EVER)))


@query("SELECT user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, count(*) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events) GROUP BY 1, 2")
def merge_keeps_ties(spark, d):
    """Each row twice, in two parts that are then merged."""
    own = LogTable(spark, _scratch(spark), merge_parts=0, index=False)
    for _ in range(2):
        own.add_rows(event_logs(spark, d))
        own.flush()
    own.compact()
    return own.scan().groupBy(F.col("stream_id").alias("user_id"), F.floor(F.col("ts_ns") / 3_600_000_000_000).cast("long").alias("hour")).agg(F.count("*").alias("n"))


@query(f"SELECT event_id, true AS partial FROM events WHERE {STICKY_3} <> 1")
def partial_subset(spark, d):
    """A root that answers no more: a partial answer is a subset, and says so."""
    own = _cluster(spark, d, 3)
    own.nodes[1].down = True
    answer = own.ask(Query(*EVER, allow_partial=True))
    return _as_events(answer.rows).select("event_id", F.lit(answer.is_partial).alias("partial"))


@query(f"SELECT event_id, CAST(user_id AS BIGINT) AS user_id, true AS partial, CAST(1 AS BIGINT) AS nodes_failed FROM events WHERE {STICKY_3} <> 2")
def cluster_partial(spark, d):
    """A root whose folder is lost."""
    own = _cluster(spark, d, 3)
    _lose(own, 2)
    answer = own.ask(Query(*EVER, allow_partial=True))
    return _as_events(answer.rows).select("event_id", "user_id", F.lit(answer.is_partial).alias("partial"), F.lit(answer.stats.nodes_failed).cast("long").alias("nodes_failed"))


@query("SELECT true AS failed, CAST(3 AS BIGINT) AS nodes_queried, CAST(1 AS BIGINT) AS nodes_failed")
def cluster_strict_lost_root(spark, d):
    own = _cluster(spark, d, 3)
    _lose(own, 0)
    try:
        stats, failed = own.ask(Query(*EVER)).stats, False
    except NodesUnavailable as why:
        stats, failed = why.stats, True
    return _one_row(spark, failed=failed, nodes_queried=stats.nodes_queried, nodes_failed=stats.nodes_failed)


@query(f"SELECT event_id, CAST(user_id AS BIGINT) AS user_id, (SELECT count(*) FROM events WHERE {STICKY_3} = 1) AS rerouted FROM events")
def cluster_reroute(spark, d):
    """A root is lost between the routing and the write: its rows go to the others, and are counted."""
    own = _cluster(spark, d, 3, write=False)
    own.add_rows(event_logs(spark, d))
    _lose(own, 1)
    own.flush()
    answer = own.ask(Query(*EVER, allow_partial=True))
    return _as_events(answer.rows).select("event_id", "user_id", F.lit(own.rerouted).cast("long").alias("rerouted"))


@query(f"SELECT CAST({STICKY_3} AS INTEGER) AS node, count(*) AS n FROM events GROUP BY 1")
def rows_per_node(spark, d):
    return spark.createDataFrame(list(enumerate(_cluster(spark, d, 3, index=False).rows_of)), "node int, n long")


@query("SELECT count(*) AS rows_matched, CAST(3 AS BIGINT) AS nodes_queried, CAST(0 AS BIGINT) AS nodes_failed FROM events WHERE event_type = 'error'")
def stats_fold(spark, d):
    """Statistics of three roots as one."""
    stats = _cluster(spark, d, 3).explain(Query(*EVER, filters=(Filter("event_type", "error"),)))
    back = SearchStats.from_json(stats.to_json())
    return _one_row(spark, rows_matched=back.rows_matched, nodes_queried=back.nodes_queried, nodes_failed=back.nodes_failed)


@query(f"SELECT count(*) AS n_rows, count(*) AS rows_matched, true AS skipped FROM events WHERE user_id = 7 AND {US} BETWEEN 1704153600000000 AND 1705363200000000")
def search_stats(spark, d):
    """Rows and statistics from one reading; blocks of other streams and times are skipped."""
    rows, stats = _event_table(spark, d).ask(Query(*SOME, stream_id=7)).run(DataFrame.count)
    return _one_row(spark, n_rows=rows, rows_matched=stats.rows_matched, skipped=stats.blocks_scanned < stats.blocks_total and stats.rows_scanned >= stats.rows_matched)


@query(f"{AS_EVENTS} WHERE event_type = 'click'")
def const_blocks(spark, d):
    """event_type is constant in each block: heads decide, exactly, and the index holds none of it."""
    own = _made(spark, d, "const", lambda: _written(spark, event_logs(spark, d).select("ts_ns", F.xxhash64(F.col("fields")["event_type"]).alias("stream_id"), F.map_concat("fields", F.create_map(F.lit("user"), F.col("stream_id").cast("string"))).alias("fields"))))
    query_ = Query(*EVER, filters=(Filter("event_type", "click"),))
    stats = own.ask(query_).stats
    assert stats.rows_scanned == own.search(query_).count(), "a constant field is decided without a wrong block"
    return own.search(query_).select(F.col("fields")["event_id"].cast("long").alias("event_id"), F.col("fields")["user"].cast("long").alias("user_id"))


@query(f"SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(text, '{W}'), 'idiot')")
def skip_candidates(spark, d):
    """By way of the token index of blocks of 64 documents of a source."""
    return _doc_table(spark, d).search(Query(*EVER, filters=(Filter("_msg", "idiot"),))).select(F.col("ts_ns").alias("doc_id"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, d):
    fields = F.col("fields")
    return _event_table(spark, d).scan().select(fields["event_id"].cast("long").alias("event_id"), F.get_json_object(fields["props"], "$.k").alias("k"))


@query("SELECT count(nullif(CASE WHEN event_type = 'click' THEN '' ELSE event_type END, '')) AS present, count(*) AS n FROM events")
def empty_is_absent(spark, d):
    emptied = F.transform_values("fields", lambda k, v: F.when((k == "event_type") & (v == "click"), "").otherwise(v))
    own = _written(spark, event_logs(spark, d).withColumn("fields", emptied), index=False)
    return own.scan().agg(F.count(F.col("fields")["event_type"]).alias("present"), F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def dup_counts(spark, d):
    return _line_table(spark, d).scan().groupBy(F.col("stream_id").alias("l_orderkey")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT n, count(*) AS keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY n")
def multiset_counts(spark, d):
    return _line_table(spark, d).scan().groupBy("stream_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("keys"))


@query("SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ORDER BY n, user_id LIMIT 1")
def cold_stream(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy("n", "user_id").limit(1)


@query("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS ties FROM (SELECT count(*) - 1 AS n FROM (SELECT user_id, date_trunc('hour', ts) AS t FROM events) GROUP BY user_id, t)")
def tie_count(spark, d):
    """Rows that share stream and time (here: the hour) with one before them."""
    per = _event_table(spark, d).scan().groupBy("stream_id", F.floor(F.col("ts_ns") / 3_600_000_000_000)).agg((F.count("*") - 1).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ties"))


@query(f"{AS_EVENTS} WHERE event_type = 'click'")
def json_api(spark, d):
    """Rows in and a query out, as JSON."""
    own = LogTable(spark, _scratch(spark))
    own.insert_json(jsonrows.render(event_logs(spark, d)))
    own.flush()
    rows, _ = own.select_json(Query(*EVER, filters=(Filter("event_type", "click"),)).to_json())
    return _as_events(jsonrows.parse(rows))


@query("SELECT count(*) AS rows_added, CAST(sum(32 + strlen('event_id') + strlen(CAST(event_id AS VARCHAR)) + 6 + strlen('event_type') + strlen(event_type) + 6 + strlen('props') + strlen(props) + 6) AS BIGINT) AS logical_bytes, true AS smaller FROM events")
def write_metrics(spark, d):
    own = _written(spark, event_logs(spark, d)).stats
    return _one_row(spark, rows_added=own.rows_added, logical_bytes=own.logical_bytes, smaller=0 < own.bytes_flushed and own.write_amplification == 1.0)


@query("SELECT CAST(25 AS BIGINT) AS rare, CAST(5000 AS BIGINT) AS common, CAST(5000 AS BIGINT) AS times, CAST(40 AS BIGINT) AS streams, true AS constant_labels")
def generated(spark, d):
    rows = generate(spark, 5000, streams=40, rare=25)
    message = F.col("fields")["_msg"]
    own = rows.agg(F.sum(has_token(message, RARE).cast("long")).alias("rare"), F.sum(has_token(message, COMMON).cast("long")).alias("common"), F.countDistinct("ts_ns").alias("times"), F.countDistinct("stream_id").alias("streams"))
    pods = rows.select("stream_id", F.col("fields")["pod"].alias("pod")).distinct().agg((F.count("*") == 40).alias("constant_labels"))
    return own.select("*", F.lit(pods.first()[0]).alias("constant_labels"))


@query("SELECT CAST(50 AS BIGINT) AS n, CAST(0 AS BIGINT) AS found")
def tokens_that_are_absent(spark, d):
    absent = [r.token for r in absent_tokens(spark, 50).collect()]
    rows = generate(spark, 2000).select(F.explode(tokens(F.col("fields")["_msg"])).alias("token"))
    return _one_row(spark, n=len(set(absent)), found=rows.where(F.col("token").isin(absent)).count())


@query("SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL")
def stream_ids(spark, d):
    """Each label set has an id of its own, which gives its labels back."""
    labels = F.create_map(F.lit("event_type"), F.col("event_type"))
    own = with_stream_id(table(spark, d, "events").select("event_id", labels.alias("labels")))
    names = own.groupBy("stream_id").agg(F.any_value(F.col("labels")["event_type"]).alias("event_type"))
    return own.join(names, "stream_id").select("event_id", "event_type")


@query("SELECT * FROM (VALUES (0, 0.1), (1, 0.2), (3, 0.8), (7, 10.0), (100, 10.0), (1000000, 10.0)) t(attempt, seconds)".replace("SELECT *", "SELECT CAST(attempt AS BIGINT) AS attempt, CAST(seconds AS DOUBLE) AS seconds"))
def backoff_times(spark, d):
    return spark.createDataFrame([(k, backoff(k)) for k in (0, 1, 3, 7, 100, 1_000_000)], "attempt long, seconds double")


@query("SELECT CAST(s AS BIGINT) AS streams, CAST(n AS BIGINT) AS nodes, round(1 + sqrt(2 * ln(n) / (s / n)), 9) AS ratio FROM (VALUES (20.0, 2.0), (100.0, 4.0), (1000.0, 8.0), (10000.0, 8.0)) t(s, n)")
def predicted_ratios(spark, d):
    return spark.createDataFrame([(s, n, round(predicted_ratio(s, n), 9)) for s, n in ((20, 2), (100, 4), (1000, 8), (10_000, 8))], "streams long, nodes long, ratio double")


@query("SELECT position, name FROM (VALUES (0, '_msg'), (1, 'level')) t(position, name)")
def query_columns(spark, d):
    asked = Query(0, 1, filters=tuple(Filter(*x) for x in (("_msg", "a"), ("level", "b"), ("_msg", "c"))))
    return spark.createDataFrame(list(enumerate(Query.from_json(asked.to_json()).columns())), "position int, name string")


@query("SELECT CAST(1 AS BIGINT) AS sent, CAST(3 AS BIGINT) AS retries, CAST(0 AS BIGINT) AS rejected, count(*) AS n_rows, count(*) AS dead FROM events")
def send_outcomes(spark, d):
    """One destination is out of reach, then fails, then takes the rows; another rejects them."""
    root, calls, taken = _scratch(spark), [], []

    def flaky(batch: DataFrame, _: int) -> None:
        calls.append(1)
        if len(calls) <= 3:
            raise Unavailable if len(calls) < 3 else OSError("server error")
        taken.append(batch.count())

    def never(batch: DataFrame, _: int) -> None:
        raise Rejected

    own = Forwarder(spark, root, {"flaky": flaky, "never": never}, least_wait=0.01, bytes_per_batch=1 << 40)
    own.add_rows(event_logs(spark, d))
    own.start(available_now=True)
    own.drain()
    stats = own.stats["flaky"]
    return _one_row(spark, sent=stats.sent, retries=stats.retries, rejected=stats.rejected, n_rows=sum(taken), dead=spark.read.parquet(f"{root}/dead-letter/never").count())
