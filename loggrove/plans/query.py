"""The query: a time range, an optional stream, whole-word filters that all hold, a limit, and whether a partial answer will do."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import has_token
from ..schema import DAY_NS, canonical, signed


#: Fixed value of the format: filters of a query that comes from outside at most.
MOST_FILTERS = 999


@dataclass(frozen=True)
class Filter:
    column: str
    token: str

    def matches(self, value: str | None) -> bool:
        import re

        return bool(self.token) and self.token in re.findall("[A-Za-z0-9]+", value or "")


@dataclass(frozen=True)
class Query:
    min_ts: int = 0
    max_ts: int = 0
    stream_id: int | None = None
    filters: tuple[Filter, ...] = field(default=())
    limit: int = 0
    allow_partial: bool = False

    def columns(self) -> list[str]:
        """Columns of the filters, each once, in order."""
        return list(dict.fromkeys(f.column for f in self.filters))

    def days(self) -> tuple[int, int]:
        return self.min_ts // DAY_NS, self.max_ts // DAY_NS

    def shard(self, shards: int) -> int:
        """The shard of the stream that is asked for."""
        m = self.stream_id % 2**64
        return (m ^ m >> 33) % shards

    def to_json(self) -> str:
        own = {"MinTimestamp": self.min_ts, "MaxTimestamp": self.max_ts, "StreamID": self.stream_id, "Filters": [{"Column": f.column, "Token": f.token} for f in self.filters], "Limit": self.limit, "AllowPartialResponse": self.allow_partial}
        return json.dumps(own, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Query:
        x = json.loads(text)
        if len(x.get("Filters") or ()) > MOST_FILTERS:
            raise ValueError(f"more than {MOST_FILTERS} filters")
        return Query(x.get("MinTimestamp", 0), x.get("MaxTimestamp", 0), x.get("StreamID"), tuple(Filter(f["Column"], f["Token"]) for f in x.get("Filters") or ()), x.get("Limit", 0), x.get("AllowPartialResponse", False))

    def matches(self, ts_ns: int, stream_id: int, fields: dict[str, str]) -> bool:
        """The same predicate on one row in Python: an oracle for tests."""
        return self.min_ts <= ts_ns <= self.max_ts and (self.stream_id is None or signed(self.stream_id) == signed(stream_id)) and all(f.matches(fields.get(f.column)) for f in self.filters)

    def predicate(self, with_day: bool = False, own: dict[str, Column] | None = None) -> Column:
        """The whole predicate; with_day adds the bounds of the partition column, which Spark doesn't infer from the time range. own: fields with columns of their own."""
        out = F.col("ts_ns").between(self.min_ts, self.max_ts)
        if with_day:
            out = F.col("day").between(*self.days()) & out
        if self.stream_id is not None:
            out = out & self.predicate_stream()
        for f in self.filters:
            out = out & has_token((own or {}).get(f.column, F.col("fields")[f.column]), f.token, null=True)
        return out

    def predicate_stream(self) -> Column:
        return F.lit(True) if self.stream_id is None else F.col("stream_id") == F.lit(signed(self.stream_id))

    def first(self, rows: DataFrame) -> DataFrame:
        """Rows in canonical order, the first `limit` of them if there is one."""
        ordered = rows.orderBy(*canonical())
        return ordered.limit(self.limit) if self.limit > 0 else ordered
