"""Synthetic logs of known content, made on the executors."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tokens that tests ask for.
RARE, COMMON, ABSENT = "zqxjkvbwpf", "request", "nonexistent"
#: Values of the fields, and the weights of those that aren't even.
LEVELS = {"debug": 50, "info": 400, "warn": 40, "error": 10}
METHODS = dict.fromkeys(["GET", "POST", "PUT", "DELETE", "PATCH"], 1)
STATUSES = {"200": 600, "201": 80, "204": 40, "301": 10, "400": 60, "401": 30, "403": 20, "404": 80, "429": 15, "500": 40, "502": 15, "503": 10}
PATHS = dict.fromkeys([f"/api/v{v}/{x}" for v in (1, 2) for x in ("items", "people", "baskets", "lookup")], 1)
SERVICES = ["edge", "login", "ledger", "basket", "till", "stock", "mail", "pay", "lookup", "post"]
REGIONS = ["north", "south", "east", "west"]
MOST_DURATION = 3000


def _hashed(seed: int, below: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(below))


def _one_of(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _weighted(weights: dict[str, int], seed: int) -> Column:
    at, out = _hashed(seed, sum(weights.values())), None
    for value, upto in zip(weights, accumulate(weights.values())):
        out = F.when(at < upto, value) if out is None else out.when(at < upto, value)
    return out


def stream_labels(s: Column, seed: int) -> dict[str, Column]:
    """Labels of stream number s, constant for each stream."""
    service = _one_of(SERVICES, F.pmod(s, F.lit(len(SERVICES))))
    pod = F.concat(service, F.lit("-"), F.call_function("div", s, F.lit(len(SERVICES))).cast("string"), F.lit("-"), F.substring(F.md5(F.concat_ws("-", s.cast("string"), F.lit(str(seed)))), 1, 4))
    return {"service": service, "pod": pod, "namespace": F.when(s % 2 == 0, "prod").otherwise("staging"), "region": _one_of(REGIONS, F.pmod(s, F.lit(len(REGIONS))))}


def generate(spark: SparkSession, rows: int, streams: int = 200, start_ns: int = 1_750_000_000_000_000_000, span_ns: int = 21_600_000_000_000, rare: int | None = None, seed: int = 42) -> DataFrame:
    """rows log rows (ts_ns, stream_id, fields) with ascending times; exactly min(rare, rows) of them hold RARE, all hold COMMON.

    rare: one row in 20000, 20 at least, if it isn't given.
    """
    rare = min(max(rows // 20_000, 20) if rare is None else rare, rows)
    step = max(1, span_ns // max(1, rows))
    every = max(1, rows // max(1, rare))
    base = spark.range(rows).withColumn("s", _hashed(seed, streams))
    ts = F.lit(start_ns) + F.col("id") * step + _hashed(seed + 1, step)
    marked = (F.pmod(F.col("id"), F.lit(every)) == 0) & (F.call_function("div", F.col("id"), F.lit(every)) < rare)
    drawn = {"level": _weighted(LEVELS, seed + 2), "method": _weighted(METHODS, seed + 3), "path": _weighted(PATHS, seed + 4), "status": _weighted(STATUSES, seed + 5), "duration_ms": _hashed(seed + 6, MOST_DURATION).cast("string")}
    base = base.select("id", "s", *[c.alias(k) for k, c in drawn.items()])
    text = F.concat_ws(" ", "level", "method", "path", F.lit(f"{COMMON} done"), F.concat(F.lit("status="), "status"), F.concat(F.lit("duration_ms="), "duration_ms"), F.when(marked, RARE))
    pairs = {"_msg": text, **{k: F.col(k) for k in drawn}, **stream_labels(F.col("s"), seed), "trace_id": F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed))))}
    return base.select(ts.alias("ts_ns"), F.xxhash64("s", F.lit(seed)).alias("stream_id"), F.create_map(*[x for k in sorted(pairs) for x in (F.lit(k), pairs[k])]).alias("fields"))


def absent_tokens(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit(ABSENT), F.lower(F.hex(F.xxhash64("id", F.lit(seed)))), F.lower(F.hex(F.xxhash64("id", F.lit(seed + 1))))).alias("token"))
