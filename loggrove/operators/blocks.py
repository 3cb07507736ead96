"""Blocks of a stream and what they are like: headers, constant columns, encoding classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BLOCK_ROWS


def cut(rows: DataFrame, stream: str, order: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with block: consecutive runs of block_rows rows of one stream."""
    n = F.row_number().over(Window.partitionBy(stream).orderBy(*order))
    return rows.withColumn("block", F.call_function("div", (n - 1).cast("long"), F.lit(block_rows).cast("long")))


def headers(blocks: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return blocks.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def is_constant(value: str) -> Column:
    """Aggregate: every row of the block has the same value, which isn't empty."""
    v = F.col(value)
    return F.coalesce((F.min(v) == F.max(v)) & (F.count(v) == F.count("*")) & (F.min(v) != ""), F.lit(False))


def encoding_class(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and enc: dict (up to 8 distinct values, fewer than rows, 256 bytes of keys), uint64 (all canonical decimals) or string."""
    number = F.expr(f"try_cast({value} AS DECIMAL(20, 0))")
    canonical = F.coalesce(F.col(value).rlike("^(0|[1-9][0-9]{0,19})$") & (number <= F.lit(str(2**64 - 1)).cast("decimal(20,0)")), F.lit(False))
    # one row for each distinct value: sums of distinct lengths without a set in memory
    distinct = values.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    found = distinct.groupBy(*keys).agg(F.count("*").alias("d"), F.sum("__n").alias("n"), F.sum(F.octet_length(value)).alias("bytes"), F.min(canonical).alias("numbers"))
    kind = F.when((F.col("d") <= 8) & (F.col("d") < F.col("n")) & (F.col("bytes") <= 256), "dict").when(F.col("numbers"), "uint64").otherwise("string")
    return found.select(*keys, kind.alias("enc"))
