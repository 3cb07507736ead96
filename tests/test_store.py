
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loggrove.functions.streams import stream_id, with_stream_id
from loggrove.plans.query import MOST_FILTERS, Filter, Query
from loggrove.plans.stats import SearchStats
from loggrove.schema import LOG_SCHEMA
from loggrove.sources import wire
from loggrove.sources.generate import LEVELS, RARE, generate
from loggrove.sources.jsonrows import render
from loggrove.sources.manifest import Manifest, Missing
from loggrove.sources.table import LogTable

EVER = (-(2**63), 2**63 - 1)


def some(spark, n=3, start=0):
    return spark.createDataFrame([(start + i, i, {"a": f"v{i}"}) for i in range(n)], LOG_SCHEMA)


def test_a_new_table_has_a_version_and_a_lost_one_has_none(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t")
    assert table.manifest().version == 0 and table.scan().count() == 0
    table.files.delete(table.root)
    with pytest.raises(Missing):
        table.scan()
    with pytest.raises(Missing):
        LogTable(spark, f"file://{tmp_path}/t", create=False).ask(Query(*EVER))


def test_a_failed_flush_keeps_what_waits(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t")
    table.add_rows(some(spark))
    table.insert_json(spark.createDataFrame([("{not json",)], "value string"))
    for _ in range(2):
        with pytest.raises(Exception):
            table.flush()
        assert table.scan().count() == 0
    table._waiting.pop()
    table.flush()
    assert table.scan().count() == 3 and table.drop_waiting() == 0


def test_a_flush_comes_before_too_much_waits(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t", most_waiting=2, index=False)
    for k in range(3):
        table.add_rows(some(spark, start=10 * k))
    assert table.scan().count() == 6 and table.drop_waiting() == 1


def test_missing_times_streams_and_fields(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t")
    table.add_rows(spark.createDataFrame([(None, 1, {"a": "x"}), (5, None, None)], LOG_SCHEMA))
    table.flush()
    assert sorted((r.ts_ns, r.stream_id, r.fields) for r in table.scan().collect()) == [(0, 1, {"a": "x"}), (5, 0, {})]


def test_missing_labels_are_the_empty_set(spark):
    rows = [(1, None), (2, {}), (3, {"a": None}), (4, {"a": ""}), (5, {"a": "b"})]
    got = {r.k: r.stream_id for r in with_stream_id(spark.createDataFrame(rows, "k int, labels map<string,string>")).collect()}
    assert got == {1: stream_id({}), 2: stream_id({}), 3: stream_id({"a": ""}), 4: stream_id({"a": ""}), 5: stream_id({"a": "b"})}


def test_searches_go_on_after_a_merge_and_vacuum_spares_what_is_new(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t", merge_parts=0)
    for k in range(2):
        table.add_rows(some(spark, start=k))
        table.flush()
    begun = table.search(Query(*EVER))
    table.compact()
    assert begun.count() == 6 == table.search(Query(*EVER)).count()  # the old files are still there
    assert table.vacuum() == 0
    late = LogTable(spark, table.root, keep_seconds=0)
    late.drop_before(-5)  # changes nothing
    late._publish(lambda parts: parts)  # any change deletes what has been gone for long enough
    assert len(table.files.names(f"{table.root}/data")) == 1 + 2 and not table.manifest().gone  # empty folders of the old parts
    assert table.vacuum(keep_seconds=0) == 2 and table.search(Query(*EVER)).count() == 6


def test_vacuum_of_days_of_a_live_part(spark, tmp_path):
    day = 86_400 * 10**9
    table = LogTable(spark, f"file://{tmp_path}/t")
    table.add_rows(spark.createDataFrame([(k * day, 1, {"a": "x"}) for k in range(3)], LOG_SCHEMA))
    table.flush()
    now = table.manifest()
    now.save(table.files, table.root, [p for p in now.parts if p.day > 0])  # a writer that died before it deleted the day
    assert table.vacuum() == 0 and table.vacuum(keep_seconds=0) == 1 and table.scan().count() == 2


def test_another_format_is_an_error(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t")
    table.files.publish(f"{table.root}/manifest/v000000000001.json", '{"format": 99, "parts": []}')
    with pytest.raises(ValueError):
        table.manifest()


def test_one_stream_opens_one_shard(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t", shards=8, block_rows=100)
    table.add_rows(generate(spark, 4000, streams=100))
    table.flush()
    assert len({p.shard for p in table.manifest().parts}) == 8
    one = table.scan().first().stream_id
    answer, stats = table.ask(Query(*EVER, stream_id=one % 2**64)).run()
    assert stats.parts_total == 8 and stats.parts_opened == stats.partitions_opened == 1 and len(answer) == stats.rows_matched == table.scan().where(F.col("stream_id") == one).count()
    again = LogTable(spark, table.root, shards=3)  # the table's own number holds
    assert again.manifest().shards == 8 and again.search(Query(*EVER, stream_id=one % 2**64)).count() == len(answer)


def test_statistics_come_from_heads_index_and_the_reading_itself(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t", block_rows=64, merge_parts=0, columns=("level",))
    table.add_rows(generate(spark, 8000, streams=40, rare=10))
    table.flush()
    q = Query(*EVER, filters=(Filter("_msg", RARE),))
    exact = table.explain(q)
    rows, stats = table.ask(q).run()
    assert len(rows) == stats.rows_matched == exact.rows_matched == 10 and stats.token_true == exact.token_true == stats.token_maybe <= 10
    limited, counted = table.ask(Query(*EVER, limit=7)).run()
    assert len(limited) == 7 and counted.rows_matched == 8000
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = table.search(Query(*EVER, filters=(Filter("level", "error"),)))._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "StringContains(f_level,error)" in plan and "IsNotNull(f_level)" in plan  # a field of its own reaches the scan
    # a field that is constant in a block is decided by the head: the index has no token of it
    index = spark.read.parquet(f"{table.root}/index")
    assert index.where("name in ('service', 'pod', 'region', 'namespace')").isEmpty()
    none, gone = table.ask(Query(*EVER, filters=(Filter("region", "nowhere"),))).run()
    assert none == [] and gone.blocks_scanned == 0 and gone.blocks_skipped_by_token == gone.blocks_total
    assert table.explain(Query(*EVER, filters=(Filter("region", "north"),))).token_false_positives == 0


def test_common_tokens_need_no_join(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t", block_rows=64)
    table.add_rows(generate(spark, 2000))
    table.flush()
    plan = lambda token: table.search(Query(*EVER, filters=(Filter("_msg", token),)))._jdf.queryExecution().toString()
    assert "LeftSemi" not in plan("request") and "LeftSemi" in plan(RARE)


def test_skip_ratios(spark, tmp_path):
    """B1, B2, B7: 25 rare rows in eight parts of 200 streams, without and with merging."""
    rows = generate(spark, 16_000, rare=25).withColumn("k", F.floor(F.rank().over(__import__("pyspark").sql.Window.orderBy("ts_ns")) / 2001)).cache()
    ratio = {}
    for merge in (0, 8):
        table = LogTable(spark, f"file://{tmp_path}/{merge}", merge_parts=merge)
        for k in range(8):
            table.add_rows(rows.where(F.col("k") == k).drop("k"))
            table.flush()
        _, stats = table.ask(Query(*EVER, filters=(Filter("_msg", RARE),))).run()
        assert stats.rows_matched == 25 and stats.blocks_scanned <= 25 and stats.skip_ratio >= 0.85
        assert table.ask(Query(*EVER, filters=(Filter("_msg", "request"),))).stats.skip_ratio == 0
        ratio[merge] = (stats.blocks_total, stats.skip_ratio, table.stats.write_amplification)
        print("blocks, skip ratio, write amplification", merge, ratio[merge])
    assert ratio[0][0] > ratio[8][0] and ratio[0][1] > 0.98 and ratio[0][2] == 1 < ratio[8][2]  # B15 too
    rows.unpersist()


def test_an_hour_of_ninety_days(spark, tmp_path):
    """B9."""
    table = LogTable(spark, f"file://{tmp_path}/t", index=False)
    day = 86_400 * 10**9
    table.add_rows(generate(spark, 9000, streams=100, span_ns=90 * day))
    table.flush()
    noon = 1_750_000_000 * 10**9 + 45 * day
    stats = table.ask(Query(noon, noon + day // 24)).stats
    assert stats.partitions_total >= 80 and 1 <= stats.partitions_opened <= 2


def test_sizes(spark, tmp_path):
    """B5 and B6: bytes at rest against logical ones, and bytes of a time."""
    table = LogTable(spark, f"file://{tmp_path}/t", columns=("level", "method", "status", "path", "service", "pod", "namespace", "region", "duration_ms", "trace_id"))
    table.add_rows(generate(spark, 60_000).coalesce(1))
    table.flush()
    files = [pq.ParquetFile(str(p)) for p in tmp_path.glob("t/data/**/*.parquet")]
    chunks = [f.metadata.row_group(g).column(0) for f in files for g in range(f.metadata.num_row_groups)]
    assert all(c.path_in_schema == "ts_ns" and "DELTA_BINARY_PACKED" in c.encodings for c in chunks)
    per_row = sum(c.total_compressed_size for c in chunks) / 60_000
    print("bytes of a time", per_row, "compression", table.stats.compression_ratio)
    assert per_row < 8 and table.stats.compression_ratio >= 5


def test_generator_weights(spark):
    rows = generate(spark, 20_000)
    share = {r.level: r.n / 20_000 for r in rows.groupBy(F.col("fields")["level"].alias("level")).agg(F.count("*").alias("n")).collect()}
    assert all(abs(share[k] - w / sum(LEVELS.values())) < 0.02 for k, w in LEVELS.items())
    first = rows.first().fields
    assert sorted(first) == ["_msg", "duration_ms", "level", "method", "namespace", "path", "pod", "region", "service", "status", "trace_id"]
    assert rows.select("stream_id", F.col("fields")["pod"]).distinct().count() == 200
    ts = [r.ts_ns for r in rows.select("ts_ns").collect()]
    assert ts == sorted(ts)


def test_wire(spark):
    """B10, and payloads that nobody should believe."""
    rows = generate(spark, 5000).coalesce(1).cache()
    payloads = wire.encode(rows)
    assert sorted(r.value for r in render(wire.decode(payloads)).collect()) == sorted(r.value for r in render(rows).collect())
    json_bytes = render(rows).agg(F.sum(F.octet_length("value"))).first()[0]
    assert json_bytes / payloads.agg(F.sum(F.octet_length("payload"))).first()[0] >= 1.5
    good = bytes(payloads.first().payload)
    for bad in (b"", good[:7], b"XXX" + good[3:], good[:3] + b"\x09" + good[4:], good[:-40], good[:4] + (1).to_bytes(4, "little") + good[8:], good[:4] + (wire.MOST_ROWS + 1).to_bytes(4, "little") + good[8:]):
        with pytest.raises(wire.Malformed):
            wire.unpack(bad)
    wide = spark.createDataFrame([(1, 1, {f"f{i}": "x" for i in range(wire.MOST_FIELDS + 1)})], LOG_SCHEMA)
    with pytest.raises(Exception, match="fields"):
        wire.encode(wide).collect()
    edges = spark.createDataFrame([(-(2**63), -1, {}), (2**63 - 1, 0, {"é": "\x00ÿ", "long": "y" * 200_000}), (1, 1, {f"f{i}": "x" for i in range(wire.MOST_FIELDS)})], LOG_SCHEMA)
    assert sorted(map(str, wire.decode(wire.encode(edges)).collect())) == sorted(map(str, edges.collect()))


def test_queries_and_statistics_as_json():
    stats = SearchStats(*range(1, 13))
    assert SearchStats.from_json(stats.to_json()) == stats
    q = Query(1, 2, 2**64 - 1, (Filter("", "é"), Filter("a", "")), 5, True)
    assert Query.from_json(q.to_json()) == q
    with pytest.raises(ValueError):
        Query.from_json(Query(filters=(Filter("a", "b"),) * (MOST_FILTERS + 1)).to_json())
    assert Manifest().version == 0
