"""The table, the cluster and routing against a brute-force scan with the same predicate."""

import random

import pytest
from pyspark.sql import functions as F

from loggrove.functions.streams import stream_id, with_stream_id
from loggrove.functions.tokens import distinct_tokens, has_token, register, tokens
from loggrove.operators.cluster import ClusterTable, NodesUnavailable
from loggrove.operators.routing import Policy, balance, route
from loggrove.plans.query import Filter, Query
from loggrove.schema import DAY_NS, LOG_SCHEMA, day_of, logical_bytes, signed
from loggrove.sources.generate import RARE, absent_tokens, generate
from loggrove.sources.manifest import Conflict
from loggrove.sources.table import LogTable

BIG = 2**63 - 1
EDGES = [
    (0, 0, {"_msg": "zero"}), (5, signed(2**64 - 1), {"_msg": "top"}), (-1, 3, {"_msg": "just before"}), (-1_500_000_000 * 10**9, 3, {"a": "x"}),
    (DAY_NS, 3, {"_msg": "", "b": "empty is absent"}), (DAY_NS - 1, 3, {}), (7, 3, {"_msg": "héllo wörld 日本 a-b_c"}), (7, 3, {"_msg": "héllo wörld 日本 a-b_c"}),
    (8, 4, {f"f{i:03d}": str(i) for i in range(64)}), (9, 4, {"long": "y" * 200_000}),
]


def rows_of(df):
    return [(r.ts_ns, r.stream_id, r.fields) for r in df.collect()]


def brute(rows, q):
    hit = [(t, s, {k: v for k, v in f.items() if v}) for t, s, f in rows]
    hit = [x for x in hit if q.matches(*x)]
    return sorted(hit, key=lambda x: (x[1] % 2**64, x[0]))


def same(got, want, limit=0):
    key = [(s % 2**64, t) for t, s, _ in got]
    assert key == sorted(key)
    as_set = lambda rows: sorted((t, s, sorted(f.items())) for t, s, f in rows)
    if limit:
        assert len(got) == min(limit, len(want)) and key == [(s % 2**64, t) for t, s, _ in want[:limit]]
        for x in as_set(got):
            assert x in as_set(want)
    else:
        assert as_set(got) == as_set(want)


def some_rows(seed, n=600):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "x1", "error", "ok"]
    return EDGES + [(rng.randrange(-2 * DAY_NS, 5 * DAY_NS), rng.choice([0, 1, 2, signed(2**64 - 1)]), {"_msg": " ".join(rng.choices(words, k=4)), "level": rng.choice(["info", "error"])}) for _ in range(n)]


def some_query(rng):
    lo, hi = sorted(rng.randrange(-2 * DAY_NS, 5 * DAY_NS) for _ in range(2))
    filters = tuple(Filter(*x) for x in rng.sample([("_msg", "alpha"), ("_msg", "Gamma"), ("level", "error"), ("_msg", "alph"), ("none", "x"), ("_msg", ""), ("_msg", "a b")], rng.choice([0, 1, 1, 2])))
    return Query(lo, hi, rng.choice([None, 0, 2**64 - 1, 99]), filters, rng.choice([0, 0, 1, 10]))


@pytest.mark.parametrize("shards, columns", [(1, ()), (3, ("level", "_msg", "not there"))])
def test_table_equals_brute_force(spark, tmp_path, shards, columns):
    rows = some_rows(1)
    table = LogTable(spark, f"file://{tmp_path}/t", block_rows=16, merge_parts=3, shards=shards, columns=columns)
    for k in range(4):
        table.add_rows(spark.createDataFrame(rows[k::4], LOG_SCHEMA))
        assert k or table.scan().count() == 0  # not before a flush
        table.flush()
    assert table.partition_days() == sorted({t // DAY_NS for t, _, _ in rows})
    rng = random.Random(2)
    everything = Query(-(2**63), BIG)
    same(rows_of(table.search(everything)), brute(rows, everything))
    for _ in range(12):
        q = some_query(rng)
        same(rows_of(table.search(q)), brute(rows, q), q.limit)
        assert Query.from_json(q.to_json()) == q
    table.compact()
    assert max(len([p for p in table.manifest().parts if (p.day, p.shard) == (d, s)]) for d in table.partition_days() for s in range(shards)) == 1
    for _ in range(5):
        q = some_query(rng)
        same(rows_of(table.search(q)), brute(rows, q), q.limit)
    table.drop_before(1)
    assert table.scan().count() == sum(t >= DAY_NS for t, _, _ in rows)
    assert table.stats.write_amplification > 1 and table.stats.rows_added == len(rows)


def test_crash_leaves_the_last_version(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    table = LogTable(spark, root)
    table.add_rows(spark.createDataFrame(EDGES, LOG_SCHEMA))
    table.flush()
    table._write(spark.createDataFrame(EDGES, LOG_SCHEMA))  # a writer that dies before it publishes
    again = LogTable(spark, root)
    assert again.scan().count() == len(EDGES) and again.vacuum() == 0 and again.vacuum(keep_seconds=0) == 1 and again.scan().count() == len(EDGES)
    with pytest.raises(Conflict):
        type(again.manifest())(0).save(again.files, root, [])


def test_skipping(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t", block_rows=64, merge_parts=0)
    table.add_rows(generate(spark, 20_000, streams=50, rare=10))
    table.flush()
    wide = (0, BIG)
    rare = table.explain(Query(*wide, filters=(Filter("_msg", RARE),)))
    assert rare.token_maybe == rare.token_true == rare.blocks_scanned and rare.token_false_positives == 0 and rare.rows_scanned >= 10 and "rows 10 of" in str(rare)
    both = table.explain(Query(*wide, filters=(Filter("_msg", RARE), Filter("level", "info"))))
    assert both.rows_matched == table.search(Query(*wide, filters=(Filter("_msg", RARE), Filter("level", "info")))).count() and both.token_false_positives >= 0
    assert rare.rows_matched == 10 and rare.blocks_scanned <= 10 and rare.skip_ratio > 0.95
    common = table.explain(Query(*wide, filters=(Filter("_msg", "request"),)))
    assert common.rows_matched == 20_000 and common.skip_ratio == 0
    absent = absent_tokens(spark, 1).first().token
    assert table.explain(Query(*wide, filters=(Filter("_msg", absent),))).blocks_scanned == 0
    plan = table.search(Query(1_750_000_000 * 10**9, 1_750_000_001 * 10**9))._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ts_ns" in plan


@pytest.mark.parametrize("policy", list(Policy))
def test_cluster_equals_brute_force(spark, tmp_path, policy):
    rows = some_rows(3, 200)
    cluster = ClusterTable(spark, [f"file://{tmp_path}/{k}" for k in range(3)], policy, threshold=20, block_rows=16)
    cluster.add_rows(spark.createDataFrame(rows, LOG_SCHEMA))
    cluster.flush()
    rng = random.Random(4)
    for _ in range(3):
        q = some_query(rng)
        same(rows_of(cluster.search(q)), brute(rows, q), q.limit)
    cluster.nodes[1].down = True
    with pytest.raises(NodesUnavailable) as failed:
        cluster.ask(Query(-(2**63), BIG))
    assert failed.value.stats.nodes_failed == 1
    part = cluster.ask(Query(-(2**63), BIG, allow_partial=True))
    whole = brute(rows, Query(-(2**63), BIG))
    got = rows_of(part.rows)
    counted = cluster.explain(Query(-(2**63), BIG))
    assert counted.nodes_queried == 3 and counted.nodes_failed == 1 and counted.rows_matched == len(got) and "partial" in str(counted)
    assert part.is_partial and len(got) < len(whole) and all(x in whole for x in got)
    cluster.add_rows(spark.createDataFrame(rows, LOG_SCHEMA))  # its share goes to the others
    cluster.flush()
    assert 0 < cluster.rerouted < len(rows) and sum(cluster.rows_of) == 2 * len(rows) and cluster.ask(Query(-(2**63), BIG, allow_partial=True)).rows.count() == len(got) + len(rows)


def test_json_forms(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t")
    texts = [
        '[{"Timestamp": 5, "StreamID": 18446744073709551615, "Fields": [{"Name": "_msg", "Value": "héllo"}, {"Name": "_msg", "Value": "second"}]}, {"Timestamp": 6}]',
        '{"Timestamp": 4, "StreamID": 9223372036854775808, "Fields": [{"Name": "a", "Value": ""}, {"Name": "b", "Value": "1"}]}', "[]",
    ]
    table.insert_json(spark.createDataFrame([(t,) for t in texts], "value string"))
    table.flush()
    rows, stats = table.select_json('{"MinTimestamp": 0, "MaxTimestamp": 10, "StreamID": null, "Filters": null, "Limit": 0}')
    assert [r.value for r in rows.collect()] == [
        '{"Timestamp":6,"StreamID":0,"Fields":[]}', '{"Timestamp":4,"StreamID":9223372036854775808,"Fields":[{"Name":"b","Value":"1"}]}',
        '{"Timestamp":5,"StreamID":18446744073709551615,"Fields":[{"Name":"_msg","Value":"héllo"}]}',
    ]
    assert stats.rows_matched == 3 and stats.partitions_total == 1
    table.insert_json(spark.createDataFrame([("{not json",)], "value string"))
    with pytest.raises(Exception):
        table.flush()
    assert table.scan().count() == 3


def test_functions(spark):
    register(spark)
    texts = ["", "...", "a-b_c", "2024-01-15T10:30:00Z", "the other", "日本the", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in df.select(tokens("s")).collect()] == [[], [], ["a", "b", "c"], ["2024", "01", "15T10", "30", "00Z"], ["the", "other"], ["the"], None]
    assert [r[0] for r in df.select(has_token("s", "the")).collect()] == [False, False, False, False, True, True, False]
    assert [r[0] for r in df.selectExpr("has_token(s, 'the')").collect()] == [False, False, False, False, True, True, False]
    assert not any(r[0] for r in df.select(has_token("s", "a-b")).collect()) and df.select(distinct_tokens("s")).count() == 7
    assert stream_id({}) == signed(0xEF46DB3751D8E999)
    got = with_stream_id(spark.createDataFrame([({"b": "2", "a": "1"},), ({"a": "1", "b": "2"},)], "labels map<string,string>")).collect()
    assert {r.stream_id for r in got} == {stream_id({"a": "1", "b": "2"})}
    ts = [-1, 0, DAY_NS - 1, DAY_NS, -DAY_NS, 2**62]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in ts], "t long").select(day_of(F.col("t"))).collect()] == [t // DAY_NS for t in ts]
    assert spark.createDataFrame([({"é": "x"},)], "fields map<string,string>").select(logical_bytes()).first()[0] == 32 + 2 + 1 + 6


def test_sticky_is_unsigned(spark):
    rng = random.Random(5)
    ids = [rng.randrange(2**64) for _ in range(500)] + [0, 2**64 - 1, 2**63]
    df = spark.createDataFrame([(signed(i),) for i in ids], "stream_id long")
    for n in (1, 3, 7, 8):
        assert [r.node for r in route(df, n, Policy.STICKY).collect()] == [(i ^ i >> 33) % n for i in ids]
    hot = spark.range(8000, numPartitions=8).select(F.col("id").alias("ts_ns"), F.lit(7).cast("long").alias("stream_id"))
    split = route(hot, 4, Policy.HYBRID, threshold=10).groupBy("node").count().collect()  # eight clients, each with its own first rows
    assert sum(r["count"] for r in split) == 8000 and all(1700 < r["count"] < 2400 for r in split) and str(Policy.HYBRID) == "hybrid"
    spread = balance(route(generate(spark, 20_000), 4, Policy.SPRAY), 4).first()
    assert spread.n_rows == 20_000 and spread.ratio <= 1.05
