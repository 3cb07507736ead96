"""Which node a row goes to: by its stream, at random, or both."""

from __future__ import annotations

import math
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.streams import sticky

STICKY_ROWS = 1000


class Policy(Enum):
    HYBRID = "hybrid"
    STICKY = "sticky"
    SPRAY = "spray"

    def __str__(self) -> str:
        return self.value


def route(rows: DataFrame, nodes: int, policy: Policy = Policy.HYBRID, stream: str = "stream_id", arrival: list[str] | None = None, threshold: int = STICKY_ROWS, spray: Column | None = None) -> DataFrame:
    """rows with node. Hybrid: the first threshold rows of a stream stay together, the rest spread.

    Each input partition is a client that counts for itself, so a hot stream is counted in as many tasks as it arrives in.
    With arrival, a stream's rows are counted as a whole in that order, which puts a stream in one task.
    """
    spray = spray if spray is not None else F.floor(F.rand(1) * nodes).cast("int")
    own = sticky(F.col(stream), nodes)
    if policy is Policy.STICKY:
        return rows.withColumn("node", own)
    if policy is Policy.SPRAY:
        return rows.withColumn("node", spray)
    if arrival:
        n = F.row_number().over(Window.partitionBy(stream).orderBy(*arrival))
        return rows.withColumn("node", F.when(n <= threshold, own).otherwise(spray))
    n = F.row_number().over(Window.partitionBy(stream, "__client").orderBy("ts_ns"))
    return rows.withColumn("__client", F.spark_partition_id()).withColumn("node", F.when(n <= threshold, own).otherwise(spray)).drop("__client")


def balance(routed: DataFrame, nodes: int) -> DataFrame:
    """(rows, busiest, ratio): the busiest node's rows over the mean."""
    per_node = routed.groupBy("node").agg(F.count("*").alias("n"))
    return per_node.agg(F.sum("n").alias("n_rows"), F.max("n").alias("busiest"), (F.max("n") * nodes / F.sum("n")).alias("ratio"))


def predicted_ratio(streams: int, nodes: int) -> float:
    """The ratio to expect of sticky routing of so many streams of equal size: balls in bins."""
    return 1 + math.sqrt(2 * math.log(nodes) / (streams / nodes)) if nodes > 1 else 1.0
