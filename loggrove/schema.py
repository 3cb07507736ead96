"""Log rows: nanosecond timestamp, unsigned stream id, string fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format.
DAY_NS = 86_400_000_000_000
BLOCK_ROWS = 8192
FORMAT = 1
LOG_SCHEMA = T.StructType([T.StructField("ts_ns", T.LongType()), T.StructField("stream_id", T.LongType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])
LOWEST = -(2**63)


def normalise(df: DataFrame) -> DataFrame:
    """The columns of a log row. At rest an empty value is an absent field. What is missing (null) is time 0, stream 0, or no fields, as in JSON rows."""
    zero = F.lit(0).cast("long")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    fields = F.coalesce(F.map_filter("fields", lambda k, v: F.coalesce(v, F.lit("")) != ""), none)
    return df.select(F.coalesce(F.col("ts_ns").cast("long"), zero).alias("ts_ns"), F.coalesce(F.col("stream_id").cast("long"), zero).alias("stream_id"), fields.alias("fields"))


def day_of(ts_ns: Column) -> Column:
    """Days since the epoch, rounded down (negative timestamps too)."""
    return F.call_function("div", ts_ns - F.pmod(ts_ns, F.lit(DAY_NS)), F.lit(DAY_NS))


def unsigned(stream_id: Column) -> Column:
    """A key that sorts stream ids (bit patterns of unsigned 64-bit numbers) as unsigned."""
    return stream_id.bitwiseXOR(F.lit(LOWEST))


def signed(stream_id: int) -> int:
    """The bit pattern of an unsigned 64-bit number as a signed one."""
    return stream_id - (1 << 64) if stream_id >= 1 << 63 else stream_id


def tie(fields: Column | str = "fields") -> Column:
    """Orders rows of one stream and time the same way wherever they are stored."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def canonical() -> list[Column]:
    """Stream (unsigned), time, then fields."""
    return [unsigned(F.col("stream_id")), F.col("ts_ns"), tie()]


def logical_bytes(fields: Column | str = "fields") -> Column:
    """32 bytes for a row, and 6 beside the bytes of name and value for each field."""
    own = F.aggregate(F.map_entries(fields), F.lit(0).cast("long"), lambda acc, e: acc + F.octet_length(e["key"]) + F.octet_length(e["value"]) + 6)
    return F.lit(32).cast("long") + F.coalesce(own, F.lit(0).cast("long"))
