"""The forwarder: outage, restart, rejection, isolation and a bounded spool."""

from pyspark.sql import functions as F

from loggrove.sources.generate import generate
from loggrove.streaming.forward import Forwarder, Rejected, Unavailable, backoff


def test_backoff():
    assert [backoff(k, 0.1, 1.0) for k in (0, 1, 2, 3, 4, 200)] == [0.1, 0.2, 0.4, 0.8, 1.0, 1.0]


def test_delivery(spark, tmp_path):
    got, calls = {"a": [], "b": []}, []

    def a(batch, _):
        calls.append(1)
        if len(calls) < 3:
            raise Unavailable
        got["a"] += [r.ts_ns for r in batch.select("ts_ns").collect()]

    def b(batch, _):
        if batch.where(F.col("fields")["level"] == "poison").count():
            raise Rejected
        got["b"] += [r.ts_ns for r in batch.select("ts_ns").collect()]

    root = f"file://{tmp_path}/f"
    rows = generate(spark, 300)
    first = Forwarder(spark, root, {"a": a, "b": b}, least_wait=0.01)
    first.add_rows(rows)
    first.start(available_now=True)
    first.drain()
    assert all(first.queue_stats(n).pending_files == 0 and first.queue_stats(n).acked_batches >= 1 for n in "ab")
    assert len(got["a"]) == len(got["b"]) == 300 and first.stats["a"].retries == 2 and first.stats["b"].retries == 0
    second = Forwarder(spark, root, {"a": a, "b": b})  # a restart goes on where the first ended
    second.add_rows(rows.withColumn("fields", F.create_map(F.lit("level"), F.lit("poison"))))
    assert second.queue_stats("a").pending_bytes > 0
    second.start(available_now=True)
    second.drain()
    assert len(got["a"]) == 600 and len(got["b"]) == 300 and second.stats["b"].rejected >= 1
    assert spark.read.parquet(f"{root}/dead-letter/b").count() == 300


def test_bounded_spool_drops_the_oldest(spark, tmp_path):
    f = Forwarder(spark, f"file://{tmp_path}/f", {}, max_spool_bytes=20_000)
    for k in range(5):
        f.add_rows(generate(spark, 200, seed=k).coalesce(1))
    assert f.dropped_files > 0 and f.dropped_bytes > 0
    assert 0 < spark.read.parquet(f"file://{tmp_path}/f/spool").count() < 1000


def test_delivered_files_go_uncounted_and_a_large_one_alone(spark, tmp_path):
    f = Forwarder(spark, f"file://{tmp_path}/f", {"a": lambda batch, _: batch.count()}, max_spool_bytes=20_000)
    f.add_rows(generate(spark, 100).coalesce(1))
    f.start(available_now=True)
    f.drain()
    delivered = {n for _, n, _ in f._held()}
    f.add_rows(generate(spark, 150, seed=1).coalesce(1))
    waiting = {n for _, n, _ in f._held()} - delivered
    f.add_rows(generate(spark, 2000, seed=2).coalesce(1))
    assert {n for _, n, _ in f._held()} == waiting and f.dropped_files == 1
    assert f.queue_stats("a").pending_files == 1 and f.queue_stats("a").dropped_files == 1
    f.start()
    f.stop(timeout=60)
    assert f.queue_stats("a").pending_files == 0


def test_torn_files_are_never_read(spark, tmp_path):
    """What a writer that died leaves in the spool: an uncommitted task's file and a hidden one, both cut off."""
    got = []
    f = Forwarder(spark, f"file://{tmp_path}/f", {"a": lambda batch, _: got.append(batch.count())})
    f.add_rows(generate(spark, 100).coalesce(1))
    spool = tmp_path / "f" / "spool"
    whole = next(spool.glob("*.parquet")).read_bytes()
    torn = spool / "_temporary" / "0" / "_temporary" / "attempt_1"
    torn.mkdir(parents=True)
    (torn / "part-00000-torn.snappy.parquet").write_bytes(whole[: len(whole) // 2])
    (spool / ".part-00001.snappy.parquet.tmp").write_bytes(whole[:5])
    f.add_rows(generate(spark, 50, seed=3).coalesce(1))  # the next writer goes on
    f.start(available_now=True)
    f.drain()
    assert sum(got) == 150 and f.queue_stats("a").pending_files == 0


def test_errors_of_a_destination_are_tried_again(spark, tmp_path):
    calls = []

    def a(batch, _):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("server error")

    f = Forwarder(spark, f"file://{tmp_path}/f", {"a": a}, least_wait=0.01)
    f.add_rows(generate(spark, 10))
    f.start(available_now=True)
    f.drain()
    assert f.stats["a"].retries == 2 and f.stats["a"].sent >= 1 and "server error" in f.stats["a"].last_error


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    sizes = []
    f = Forwarder(spark, f"file://{tmp_path}/f", {"a": lambda batch, _: sizes.append(batch.count())}, bytes_per_batch=1)
    for k in range(3):
        f.add_rows(generate(spark, 20, seed=k).coalesce(1))
    f.start(available_now=True)
    f.drain()
    assert sizes == [20, 20, 20]  # a file at a time


def test_a_stop_ends_the_retries(spark, tmp_path):
    def a(batch, _):
        raise Unavailable

    f = Forwarder(spark, f"file://{tmp_path}/f", {"a": a}, least_wait=0.05, most_wait=30.0)
    f.add_rows(generate(spark, 10))
    f.start()
    f.stop(timeout=1.0)
    assert not any(q.isActive for q in f.queries.values()) and f.queue_stats("a").pending_files > 0
