"""Log rows as JSON: {"Timestamp", "StreamID" (unsigned), "Fields": [{"Name", "Value"}]}."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed names of the format.
ROWS = "ARRAY<STRUCT<Timestamp: BIGINT, StreamID: DECIMAL(20, 0), Fields: ARRAY<STRUCT<Name: STRING, Value: STRING>>>>"
TOP = 2**64


def parse(texts: DataFrame, column: str = "value") -> DataFrame:
    """Log rows of JSON texts, each an object or an array of them. What is missing is zero or empty; of equal names the first holds."""
    rows = texts.select(F.explode(F.from_json(column, ROWS, {"mode": "FAILFAST"})).alias("r")).select("r.*")
    names = F.transform("Fields", lambda f: f["Name"])
    first = F.filter("Fields", lambda f, i: f["Name"].isNotNull() & (F.array_position(names, f["Name"]) == i + 1))
    unsigned = F.coalesce("StreamID", F.lit(0).cast("decimal(20,0)"))
    bits = F.when(unsigned >= F.lit(str(TOP // 2)).cast("decimal(20,0)"), unsigned - F.lit(str(TOP)).cast("decimal(21,0)")).otherwise(unsigned)
    fields = F.map_from_entries(F.coalesce(first, F.array().cast("array<struct<Name:string,Value:string>>")))
    return rows.select(F.coalesce("Timestamp", F.lit(0)).alias("ts_ns"), bits.cast("long").alias("stream_id"), fields.alias("fields"))


def render(rows: DataFrame) -> DataFrame:
    """(value): a JSON text for each log row, fields by name; keeps the order of rows."""
    id_ = F.col("stream_id").cast("decimal(21,0)")
    unsigned = F.when(F.col("stream_id") < 0, id_ + F.lit(str(TOP)).cast("decimal(21,0)")).otherwise(id_).cast("decimal(20,0)")
    fields = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.struct(e["key"].alias("Name"), e["value"].alias("Value")))
    return rows.select(F.to_json(F.struct(F.col("ts_ns").alias("Timestamp"), unsigned.alias("StreamID"), fields.alias("Fields"))).alias("value"))
