"""Stream ids from labels, and placement of streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import signed


def stream_id(labels: dict[str, str]) -> int:
    """64-bit xxHash (seed 0) of name=value, each with a NUL after it, by name; as a signed bit pattern."""
    import xxhash

    return signed(xxhash.xxh64_intdigest("".join(f"{k}={v}\0" for k, v in sorted(labels.items())).encode(), seed=0))


def with_stream_id(df: DataFrame, labels: str = "labels") -> DataFrame:
    """df with stream_id from a map of labels; no labels (null) are an empty set, a null value is an empty one. Only distinct label sets are hashed in Python, then joined back."""
    key = F.coalesce(F.to_json(F.array_sort(F.map_entries(labels))), F.lit("[]"))

    @F.pandas_udf("long")
    def hashed(text: pd.Series) -> pd.Series:
        import json

        return text.map(lambda t: stream_id({e["key"]: e.get("value") or "" for e in json.loads(t)}))

    keyed = df.withColumn("__labels", key)
    ids = keyed.select("__labels").distinct().select("__labels", hashed("__labels").alias("stream_id"))
    return keyed.join(ids, "__labels").drop("__labels")


def mixed(stream: Column) -> Column:
    return stream.bitwiseXOR(F.shiftrightunsigned(stream, 33))


def sticky(stream: Column, n: int) -> Column:
    """The mixed id modulo n, as unsigned numbers."""
    m = mixed(stream)
    return F.pmod(F.pmod(m, F.lit(n)) + F.when(m < 0, F.lit(2**64 % n)).otherwise(F.lit(0)), F.lit(n)).cast("int")
