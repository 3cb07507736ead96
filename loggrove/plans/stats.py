"""What a search read, skipped and found."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields


@dataclass
class SearchStats:
    partitions_total: int = 0
    partitions_opened: int = 0
    parts_total: int = 0
    parts_opened: int = 0
    blocks_total: int = 0
    blocks_skipped_by_time: int = 0
    blocks_skipped_by_stream: int = 0
    blocks_skipped_by_token: int = 0
    blocks_scanned: int = 0
    rows_matched: int = 0
    nodes_queried: int = 0
    nodes_failed: int = 0
    rows_scanned: int = 0
    #: Blocks that the token index let through, and those of them with a row that matches.
    token_maybe: int = 0
    token_true: int = 0
    #: Size of the opened parts' files: what a search reads at most.
    bytes_opened: int = 0

    def merge(self, other: SearchStats) -> SearchStats:
        return SearchStats(*(getattr(self, f.name) + getattr(other, f.name) for f in fields(self)))

    @property
    def is_partial(self) -> bool:
        return self.nodes_failed > 0

    @property
    def skip_ratio(self) -> float:
        return 1 - self.blocks_scanned / self.blocks_total if self.blocks_total else 0.0

    @property
    def token_false_positives(self) -> int:
        return self.token_maybe - self.token_true

    def __str__(self) -> str:
        nodes = f"; nodes {self.nodes_queried - self.nodes_failed} of {self.nodes_queried}{', partial' if self.is_partial else ''}" if self.nodes_queried else ""
        return (
            f"days {self.partitions_opened} of {self.partitions_total}; parts {self.parts_opened} of {self.parts_total}; blocks {self.blocks_scanned} of {self.blocks_total}"
            f" (by time -{self.blocks_skipped_by_time}, by stream -{self.blocks_skipped_by_stream}, by token -{self.blocks_skipped_by_token}; {self.skip_ratio:.2%} skipped);"
            f" index {self.token_true} right, {self.token_false_positives} wrong; rows {self.rows_matched} of {self.rows_scanned}; {self.bytes_opened / 2**20:.1f} MiB{nodes}"
        )

    def as_dict(self) -> dict[str, int]:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> SearchStats:
        """Every field, by name; an unknown name is an error, a missing one is 0."""
        return SearchStats(**json.loads(text))


@dataclass
class GlobalStats:
    rows_added: int = 0
    logical_bytes: int = 0
    bytes_written: int = 0
    bytes_flushed: int = 0

    def reset(self) -> None:
        self.__init__()

    @property
    def write_amplification(self) -> float:
        return self.bytes_written / self.bytes_flushed if self.bytes_flushed else 0.0

    @property
    def compression_ratio(self) -> float:
        return self.logical_bytes / self.bytes_flushed if self.bytes_flushed else 0.0
