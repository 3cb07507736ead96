"""Line dedup by winnowing over line hashes.

A document is a sequence of lines, each with a 128-bit hash and a number of words. A window is the shortest run of lines from
a line on that has min_words words; the line with the least hash among those of each window that have words is a fingerprint,
so every run of min_words words or more holds one, chosen by the run's content alone. Fingerprints that occur more than once are joined back to their
positions; from these, matches are extended both ways: over the shortest runs of min_words words that begin, or end, at each
line of the windows around a match. A line goes if a run of min_words words or more covers it that also starts earlier
(smaller doc_id, or same document and earlier line). The two kinds of shortest runs cover exactly the lines that runs of any
length do, so no pairs of occurrences are listed and a passage that a third of all documents share costs one row each.

All steps but the first and the last work on hashes (16 bytes a line); texts are read for hashing, and shuffled once for cutting.
Each step is linear in the lines of a document: minima by a sliding queue, hashes of runs from prefix sums, intervals to cut.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
#: A prime and a base below it, for hashes of runs; rows that a task returns at once.
PRIME, BASE = 2**127 - 1, 0x5851F42D4C957F2D14057B7EF767814F
ROWS = 100_000
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def lines_of(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The lines and their numbers of words (runs of bytes other than ASCII white space)."""
    lines = text.split(b"\n")
    raw = np.frombuffer(b" " + text, np.uint8)
    inside = ~SPACE[raw]
    upto = np.r_[0, np.cumsum(inside[1:] & ~inside[:-1])]
    ends = np.cumsum([len(x) + 1 for x in lines]) - 1
    return lines, np.diff(np.r_[0, upto[ends]])


def spans(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends (excluded) of the shortest runs of least words that begin at lines 0, 1, ..., as far as there are any; starts of those that end at each line, -1 for none."""
    total = np.r_[0, np.cumsum(words)]
    ahead = np.searchsorted(total, total[:-1] + least)  # least j with words of lines i to j - 1 enough
    ahead = np.maximum(ahead, np.arange(len(words)) + 1)
    behind = np.searchsorted(total, total[1:] - least, side="right") - 1  # largest i with words of lines i to j enough
    return ahead[ahead <= len(words)], np.where(total[1:] >= least, np.minimum(behind, np.arange(len(words))), -1)


def minima(hashes: list[bytes], words: list[int], ahead: list[int]) -> list[int]:
    """The line with words that has the least hash (the last of equals) in each run from i to ahead[i]."""
    out, queue, j = [], deque(), 0
    for i, end in enumerate(ahead):
        while j < end:
            if words[j]:
                while queue and hashes[queue[-1]] >= hashes[j]:
                    queue.pop()
                queue.append(j)
            j += 1
        while queue[0] < i:
            queue.popleft()
        out.append(queue[0])
    return out


class Runs:
    """Hashes of any run of lines, from prefix sums modulo a prime of 127 bits."""

    def __init__(self, hashes: list[bytes]):
        self.upto, self.power = [0], [1]
        for h in hashes:
            self.upto.append((self.upto[-1] * BASE + int.from_bytes(h, "little") + 1) % PRIME)

    def of(self, i: int, j: int) -> bytes:
        """Of lines i to j - 1."""
        while len(self.power) <= j - i:
            self.power.append(self.power[-1] * BASE % PRIME)
        own = (self.upto[j] - self.upto[i] * self.power[j - i]) % PRIME
        return hashlib.blake2b(own.to_bytes(16, "little") + (j - i).to_bytes(8, "little"), digest_size=16).digest()


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_h, hashes binary, words array) of each row."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.pieces(batch, limit=4 * common.PIECE_BYTES):
                out, own = [], []
                for t in piece.column(1).to_pylist():
                    lines, words = lines_of(t.encode())
                    out.append(b"".join(xxhash.xxh3_128_digest(x) for x in lines))
                    own.append(words.astype(np.int32))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(out, pa.binary()), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "text_h", "hashes", "words"])

    return common.stored(docs.mapInArrow(run, "doc_id long, text_h long, hashes binary, words array<int>"), "lines")


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_h, gone array of (first, last) line numbers) of the rows of docs (doc_id, text, text_h) that lose lines."""
    table = _lines(docs)

    def cut(data: bytes) -> list[bytes]:
        return [data[i : i + 16] for i in range(0, len(data), 16)]

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text, line, h = [], [], [], []
            for d, t, data, words in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = cut(data)
                for i in sorted(set(minima(hashes, words, spans(np.array(words), min_words)[0].tolist()))):
                    doc.append(d), text.append(t), line.append(i), h.append(hashes[i])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "text_h": pa.array(text, pa.int64()), "line": pa.array(line, pa.int32()), "h": pa.array(h, pa.binary())})

    marks = common.stored(table.mapInArrow(fingerprints, "doc_id long, text_h long, line int, h binary"), "line-marks")
    # a fingerprint in several places: one row for each task and hash before the shuffle
    twice = common.stored(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "line-twice")
    matched = common.join_spread(marks, twice, "h").groupBy("doc_id", "text_h").agg(F.collect_list("line").alias("lines"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, data, words, lines in zip(*(c.to_pylist() for c in batch.columns)):
                hashes, known = cut(data), set(lines)
                ahead, behind = spans(np.array(words), min_words)
                hit = np.zeros(len(words) + 1, dtype=bool)
                hit[: len(ahead)] = [m in known for m in minima(hashes, words, ahead.tolist())]
                first = np.r_[np.flatnonzero(hit[: len(ahead)]), behind[hit[behind]]]
                end = np.r_[ahead[hit[: len(ahead)]], np.flatnonzero(hit[behind]) + 1]
                both = np.unique(np.stack([first, end], axis=1), axis=0)
                runs = Runs(hashes)
                for s in range(0, len(both), ROWS):
                    few = both[s : s + ROWS]
                    h = [runs.of(i, j) for i, j in few.tolist()]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d] * len(few), pa.int64()), "text_h": pa.array([t] * len(few), pa.int64()), "first": pa.array(few[:, 0], pa.int32()), "last": pa.array(few[:, 1] - 1, pa.int32()), "h": pa.array(h, pa.binary())})

    both = table.join(matched, table["doc_id"].eqNullSafe(matched["doc_id"]) & (table["text_h"] == matched["text_h"])).select(table["doc_id"], table["text_h"], "hashes", "words", "lines")
    runs = common.stored(both.mapInArrow(extend, "doc_id long, text_h long, first int, last int, h binary"), "line-runs")
    earliest = runs.groupBy("h").agg(F.min(F.struct("doc_id", "text_h", "first")).alias("at"), F.count("*").alias("n")).where("n > 1").select("h", "at", "n")
    later = common.join_spread(runs, common.stored(earliest, "line-earliest"), "h").where(F.struct("doc_id", "text_h", "first") > F.col("at"))
    return later.groupBy("doc_id", "text_h").agg(F.collect_list(F.struct("first", "last")).alias("gone"))


def without(text: str, gone: list[dict]) -> tuple[str, int, int]:
    """The text less the lines of all intervals, its number of lines, and how many went."""
    lines = text.split("\n")
    edge = np.zeros(len(lines) + 1, np.int64)
    np.add.at(edge, [g["first"] for g in gone], 1)
    np.add.at(edge, [g["last"] + 1 for g in gone], -1)
    out = np.cumsum(edge[:-1]) > 0
    return "\n".join([x for x, g in zip(lines, out.tolist()) if not g]), len(lines), int(out.sum())


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """(doc_id, text, n_lines, n_removed[, row]): every row of docs with its text less the lines of later repeated runs.

    row: a struct of all other columns of docs, so none of them can clash with these names. A null or empty text has one empty
    line and loses none. Runs within one document count too. Rows that repeat both id and text count as one and get the same
    result; rows of one id with other texts are ordered by a hash of their text; rows without an id come first. A document of
    which nothing is left has an empty text and n_removed = n_lines. An empty table gives an empty one.
    """
    extra = [common.packed(docs, (text_col,)).alias("row")] if row else []
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *extra).withColumn("text_h", F.xxhash64("text"))
    gone = removals(base.select("doc_id", "text", "text_h"), min_words)
    joined = base.join(gone, base["doc_id"].eqNullSafe(gone["doc_id"]) & (base["text_h"] == gone["text_h"]), "left").select(base["doc_id"], "text", "gone", *(["row"] if row else []))

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.pieces(batch, limit=4 * common.PIECE_BYTES):
                out = [without(t, g) if g else (t, t.count("\n") + 1, 0) for t, g in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist())]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([piece.column(0), *columns, *piece.columns[3:]], names=made.names)

    made = common.schema("doc_id long, text string, n_lines long, n_removed long")
    if row:
        made = made.add("row", joined.schema["row"].dataType)
    return joined.mapInArrow(run, made)


#: DuckDB SQL for (doc_id, n_lines, n_removed, kept_sha256) over documents.
SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents}),
each AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs),
counted AS (SELECT doc_id, ls, i, len(regexp_extract_all(ls[i], '[^\x09-\x0D\x20]+')) AS w FROM each),
cum AS (SELECT doc_id, ls, i, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM counted),
ahead AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= {least} GROUP BY ALL),
behind AS (SELECT b.doc_id, max(a.i) AS i, b.i AS j FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= {least} GROUP BY b.doc_id, b.i),
runs AS (SELECT r.doc_id, r.i, r.j, array_to_string(list_slice(d.ls, r.i, r.j), chr(10)) AS body FROM (SELECT doc_id, i, j FROM ahead UNION SELECT doc_id, i, j FROM behind) r JOIN docs d USING (doc_id)),
firsts AS (SELECT doc_id, i, j, min(doc_id * 1000000 + i) OVER (PARTITION BY body) AS f FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM firsts WHERE f < doc_id * 1000000 + i),
kept AS (SELECT e.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(e.ls[e.i], chr(10) ORDER BY e.i) FILTER (WHERE g.i IS NULL), '') AS body
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
"""


def oracle(documents: str = "documents", least: int = MIN_WORDS) -> str:
    return SQL.format(documents=documents, least=least) + "SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(body) AS kept_sha256 FROM kept"
