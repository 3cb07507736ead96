"""Log rows in transit: Arrow record batches, compressed, behind a short head, with bounds that a reader checks before it believes them.

Queries and statistics travel as JSON (Query.to_json, SearchStats.to_json).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..schema import LOG_SCHEMA, normalise

#: Fixed values of the format: fields of a row and rows of a batch at most.
MOST_FIELDS, MOST_ROWS = 999, 10_000_000
MAGIC, VERSION = b"LGW", 1
HEAD = struct.Struct("<3sBI")
ARROW = pa.schema([("ts_ns", pa.int64()), ("stream_id", pa.int64()), ("names", pa.list_(pa.string())), ("values", pa.list_(pa.string()))])
#: Rows of a payload that encode() makes.
PAYLOAD_ROWS = 65_536


class Malformed(ValueError):
    """A payload that isn't one of this format, or goes beyond its bounds."""


def pack(batch: pa.RecordBatch) -> bytes:
    """One payload from (ts_ns, stream_id, fields)."""
    maps = batch.column("fields")
    if len(maps) > MOST_ROWS:
        raise Malformed(f"more than {MOST_ROWS} rows")
    names, values = [], []
    for fields in maps.to_pylist():
        if len(fields) > MOST_FIELDS:
            raise Malformed(f"more than {MOST_FIELDS} fields")
        names.append([k for k, _ in fields]), values.append([v for _, v in fields])
    # names repeat from row to row: a dictionary of whole lists would need their types, the compressor needs nothing
    body = pa.RecordBatch.from_arrays([batch.column("ts_ns"), batch.column("stream_id"), pa.array(names, ARROW.field(2).type), pa.array(values, ARROW.field(3).type)], schema=ARROW)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ARROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(body)
    return HEAD.pack(MAGIC, VERSION, len(maps)) + sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    if len(payload) < HEAD.size:
        raise Malformed("cut off")
    magic, version, n = HEAD.unpack_from(payload)
    if magic != MAGIC or version != VERSION:
        raise Malformed("not a payload of this version")
    if n > MOST_ROWS:
        raise Malformed(f"more than {MOST_ROWS} rows")
    try:
        batch = pa.ipc.open_stream(memoryview(payload)[HEAD.size :]).read_next_batch()
        batch.validate(full=True)
    except (pa.ArrowException, StopIteration, OSError) as why:
        raise Malformed(str(why)) from why
    if batch.schema != ARROW or batch.num_rows != n:
        raise Malformed("head and body differ")
    names, values = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    if any(len(k) > MOST_FIELDS or len(k) != len(v) for k, v in zip(names, values)):
        raise Malformed(f"more than {MOST_FIELDS} fields, or names without values")
    fields = pa.array([list(zip(k, v)) for k, v in zip(names, values)], pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fields], names=["ts_ns", "stream_id", "fields"])


def encode(rows: DataFrame, payload_rows: int = PAYLOAD_ROWS) -> DataFrame:
    """(payload binary): log rows by batches of a task, payload_rows at most in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, payload_rows):
                yield pa.RecordBatch.from_pydict({"payload": pa.array([pack(batch.slice(s, payload_rows))], pa.binary())})

    return normalise(rows).mapInArrow(run, "payload binary")


def decode(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The log rows of payloads; a payload that isn't valid fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                yield unpack(payload.as_py())

    return payloads.select(column).mapInArrow(run, LOG_SCHEMA)
