"""Benchmark decontamination: an FM-index for each training shard, searched backwards for every benchmark window.

A shard is a piece of an input partition. Its texts become one sequence of word numbers: a word that no benchmark item has
is a separator, runs between separators that are shorter than the shortest window are left out (no window can occur in
them), so the index holds just what a window could match. The sequence's suffixes are sorted by prefix doubling; a wavelet
matrix over its Burrows-Wheeler transform answers ranks; all windows whose words the shard has are searched backwards at
once; occurrences are located by walking to sampled suffix positions; the hit words of a document are merged into spans.

The benchmark is never held as a whole: beyond BLOCK_BYTES it is dealt into blocks by hash, and each block is broadcast for a
pass of its own over the texts, which returns the hit words of hit documents alone; they are merged by document at the end.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of benchmark text in one broadcast block, about; a larger benchmark is searched block by block.
BLOCK_BYTES = 16 << 20
SAMPLE = 8
#: Windows that are searched at once.
AT_ONCE = 1 << 16


def _word_bytes() -> np.ndarray:
    """Whether a byte of lower-cased UTF-8 belongs to a word: digits, a-z, and all of a non-ASCII character."""
    own = np.zeros(256, dtype=bool)
    own[0x30:0x3A] = own[0x61:0x7B] = True
    own[0x80:] = True
    return own


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
WORD = _word_bytes()
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words(raw: np.ndarray, lower: np.ndarray = LOWER, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and 64-bit hashes of the words of raw bytes (mapped by lower; word says which bytes belong to one)."""
    low = lower[raw]
    inside = word[low]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    length = ends - starts
    hashes = np.zeros(len(starts), np.uint64)
    # words in order of length, so that byte k only goes over the words that have one
    order = np.argsort(-np.minimum(length, 2**15 - 1).astype(np.int16), kind="stable")
    sorted_starts, sorted_length = starts[order], length[order]
    mixed = np.zeros(len(order), np.uint64)
    long = int(np.searchsorted(-sorted_length, -63, "left"))  # those over 63 bytes: hashed one by one
    n = len(order)
    with np.errstate(over="ignore"):
        for k in range(min(63, int(sorted_length[long]) if long < n else 0)):
            n = int(np.searchsorted(-sorted_length, -k, "left"))
            few = slice(long, n)
            mixed[few] = (mixed[few] ^ (low[sorted_starts[few] + k].astype(np.uint64) + np.uint64(1))) * ODD
            mixed[few] ^= mixed[few] >> np.uint64(29)
    for i in range(long):
        s = sorted_starts[i]
        mixed[i] = np.frombuffer(hashlib.blake2b(low[s : s + sorted_length[i]].tobytes(), digest_size=8).digest(), "<u8")[0]
    hashes[order] = mixed
    return starts, ends, hashes


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; the last symbol is the only least one."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
        rank[order] = new
        if new[-1] == n - 1 or k >= n:
            return order
        k *= 2


class FMIndex:
    """Over numbers 0 (the end) to top."""

    def __init__(self, text: np.ndarray, top: int):
        self.n = len(text)
        order = suffix_array(text)
        last = text[order - 1]
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = max(1, int(top).bit_length())
        at = last
        for b in range(self.bits - 1, -1, -1):
            bit = (at >> b & 1).astype(bool)
            zeros = np.r_[0, np.cumsum(~bit)].astype(np.int32)
            self.levels.append((zeros, int(zeros[-1])))
            at = np.r_[at[~bit], at[bit]]
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=top + 1))]
        self.last = last
        sampled = order % SAMPLE == 0
        self.sampled = np.r_[0, np.cumsum(sampled)].astype(np.int32)
        self.positions = order[sampled]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often symbol stands in the first upto places of the transform."""
        low, high = np.zeros(len(symbol), np.int64), upto.astype(np.int64)
        for b, (zeros, total) in zip(range(self.bits - 1, -1, -1), self.levels):
            one = symbol >> b & 1
            z_low, z_high = zeros[low], zeros[high]
            low = np.where(one, total + low - z_low, z_low)
            high = np.where(one, total + high - z_high, z_high)
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row of patterns."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order, by walking back to a sampled one."""
        out, at, walked, live = np.empty(len(rows), np.int64), rows.astype(np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(live):
            here = at[live]
            known = self.sampled[here + 1] > self.sampled[here]
            out[live[known]] = self.positions[self.sampled[here[known]]] + walked[live[known]]
            live, here = live[~known], here[~known]
            c = self.last[here]
            at[live] = self.before[c] + self.rank(c, here)
            walked[live] += 1
        return out


class Benchmark:
    """A block of items as one sequence of word numbers, and where windows start in it, by their length (some 20 bytes a word)."""

    def __init__(self, items: list[tuple], width: int):
        hashes = [words(np.frombuffer((t or "").encode(), np.uint8))[2] for _, t in items]
        self.ids = [str(i) for i, _ in items]
        every = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.vocabulary, numbers = np.unique(every, return_inverse=True)
        self.words = numbers.astype(np.int32) + 2  # 0 ends the text, 1 separates
        size = np.array([len(h) for h in hashes], np.int64)
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), size)
        first = np.repeat(np.cumsum(size) - size, size)
        at = np.arange(len(every))
        length = np.minimum(size, width)[self.item] if len(every) else np.zeros(0, np.int64)
        starts = (at + length <= first + size[self.item]) if len(every) else np.zeros(0, dtype=bool)
        self.windows = {int(n): np.flatnonzero(starts & (length == n)) for n in np.unique(length)}
        self.shortest = min(self.windows, default=0)

    def hits(self, hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, list[set[int]]]:
        """Which words are hit, and the items that occur in each document."""
        none = np.zeros(len(hashes), dtype=bool)
        hit, items = np.zeros(len(hashes) + 1, np.int64), [set() for _ in range(n_docs)]
        if not self.windows or not len(hashes):
            return none, items
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == hashes
        # runs of known words within a document
        new = np.r_[True, (doc[1:] != doc[:-1]) | ~known[1:] | ~known[:-1]]
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        keep = np.flatnonzero(known & (size[run] >= self.shortest))
        if not len(keep):
            return none, items
        head = np.r_[True, run[keep][1:] != run[keep][:-1]]
        place = np.arange(len(keep)) + np.cumsum(head)  # a separator before each run
        text = np.ones(place[-1] + 2, np.int64)
        text[-1] = 0
        text[place] = at[keep] + 2
        back = np.zeros(len(text), np.int64)
        back[place] = keep
        index = None
        here = np.zeros(len(self.vocabulary) + 2, dtype=bool)
        here[text] = True
        absent = np.r_[0, np.cumsum(~here[self.words], dtype=np.int32)]
        for n, every in self.windows.items():
            live = every[absent[every + n] == absent[every]]
            for s in range(0, len(live), AT_ONCE):
                few = live[s : s + AT_ONCE]
                patterns, of = np.unique(self.words[few[:, None] + np.arange(n)], axis=0, return_inverse=True)
                index = index or FMIndex(text, len(self.vocabulary) + 1)
                low, high = index.search(patterns.astype(np.int64))
                found = np.flatnonzero(high > low)
                if not len(found):
                    continue
                counts = (high - low)[found]
                rows = np.repeat(low[found] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                starts = back[index.locate(rows)]
                np.add.at(hit, starts, 1)
                np.add.at(hit, starts + n, -1)
                order = np.argsort(of.ravel(), kind="stable")
                ends = np.searchsorted(of.ravel()[order], np.arange(len(patterns) + 1))
                for d, p in np.unique(np.stack([doc[starts], np.repeat(found, counts)], axis=1), axis=0).tolist():
                    items[d].update(self.item[few[order[ends[p] : ends[p + 1]]]].tolist())
        return np.cumsum(hit[:-1]) > 0, items


class Piece:
    """The words of some texts."""

    def __init__(self, texts: list[str]):
        self.texts = [t.encode() for t in texts]
        self.starts, self.ends, self.hashes = words(np.frombuffer(b"\n".join(self.texts) + b"\n", np.uint8))
        self.bounds = np.cumsum([len(t) + 1 for t in self.texts])
        self.doc = np.searchsorted(self.bounds, self.starts, side="right")
        self.n_words = np.bincount(self.doc, minlength=len(texts))

    def runs(self, hit: np.ndarray) -> list[list[tuple[int, int]]]:
        """First and last word of each run of hit words of each text, counted in the piece."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.texts]
        at = np.flatnonzero(hit)
        if len(at):
            first = np.r_[True, (np.diff(at) > 1) | (self.doc[at][1:] != self.doc[at][:-1])]
            for h, t in zip(at[first].tolist(), at[np.r_[first[1:], True]].tolist()):
                out[int(self.doc[h])].append((h, t))
        return out

    def spans(self, d: int, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
        """Start and end in characters of text d of runs of words."""
        own, zero = self.texts[d], int(self.bounds[d]) - len(self.texts[d]) - 1
        out, upto, chars = [], 0, 0
        for h, t in runs:
            s, e = int(self.starts[h]) - zero, int(self.ends[t]) - zero
            start = chars + len(own[upto:s].decode())
            chars, upto = start + len(own[s:e].decode()), e
            out.append({"start": start, "end": chars})
        return out

    def without(self, d: int, runs: list[tuple[int, int]]) -> str:
        """Text d less runs of words."""
        own, zero = self.texts[d], int(self.bounds[d]) - len(self.texts[d]) - 1
        out, upto = [], 0
        for h, t in runs:
            out.append(own[upto : int(self.starts[h]) - zero])
            upto = int(self.ends[t]) - zero
        return b"".join([*out, own[upto:]]).decode()


_READY: dict[str, Benchmark] = {}


def _ready(key: str, items: list[tuple], width: int) -> Benchmark:
    """The block that this worker has last worked with, or a new one."""
    if key not in _READY:
        _READY.clear()
        _READY[key] = Benchmark(items, width)
    return _READY[key]


SPANS = "array<struct<start:int,end:int>>"


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, row: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans[, text, row]) of every row of docs.

    items: ids of items with an occurring window, as sorted distinct strings. spans: merged hit words as (start, end) in
    characters of the text, end exclusive. row: a struct of all other columns of docs, so none of them can clash with these
    names. Null and empty texts have no words and no hits; an empty benchmark hits nothing; items without an id count as
    "None"; repeated rows stay, each with its own result; an empty table gives an empty one. A benchmark of block_bytes or
    less is broadcast, and no text is shuffled. A larger one is searched block by block, with one pass over the texts for each;
    what they hit is then joined to the texts by id and a hash of the text.
    """
    return _search(docs, benchmark, False, width, id_col, text_col, item_id, item_text, block_bytes, row)


def _search(docs: DataFrame, benchmark: DataFrame, cutting: bool, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, row: bool = False) -> DataFrame:
    """find(), or cut() if cutting: by the worker that has found the hits, since a second one would stay in memory beside it."""
    spark = docs.sparkSession
    extra = [common.packed(docs, (text_col,)).alias("row")] if row else []
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *extra)
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // block_bytes))
    made = common.schema("doc_id long, text string" if cutting else f"doc_id long, n_words long, n_hit long, items array<string>, spans {SPANS}")
    if row:
        for f in base.schema.fields[2 if cutting else 1 :]:
            made = made.add(f.name, f.dataType)
    list_of = {"items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}

    def result(piece: pa.RecordBatch, own: Piece, hit: np.ndarray, ids: list[list[str]], rest: list) -> pa.RecordBatch:
        """rest: the text as it came, and row, if row is wanted."""
        if cutting:
            texts = piece.column(1)
            if hit.any():
                texts = pa.array([own.without(d, r) if r else t for d, (t, r) in enumerate(zip(texts.to_pylist(), own.runs(hit)))], pa.string())
            return pa.RecordBatch.from_arrays([piece.column(0), texts, *rest[1:]], names=made.names)
        spans = [own.spans(d, r) if r else [] for d, r in enumerate(own.runs(hit))]
        n_hit = np.bincount(own.doc[hit], minlength=len(own.texts))
        out = [piece.column(0), pa.array(own.n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, list_of["items"]), pa.array(spans, list_of["spans"])]
        return pa.RecordBatch.from_arrays([*out, *rest], names=made.names)

    def searched(block: list[tuple]):
        held, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Piece, np.ndarray, list[list[str]]]]:
            ready = _ready(key, held.value, width)
            for batch in batches:
                for piece in common.pieces(batch, limit=4 * common.PIECE_BYTES):
                    own = Piece(piece.column(1).to_pylist())
                    hit, of = ready.hits(own.hashes, own.doc, len(own.texts))
                    yield piece, own, hit, [sorted({ready.ids[i] for i in x}) for x in of]

        return held, found

    if blocks == 1:
        _, found = searched([tuple(r) for r in items.collect()])  # block_bytes at most
        return base.mapInArrow(common.lean(lambda batches: (result(p, own, hit, ids, p.columns[1:] if row else []) for p, own, hit, ids in found(batches))), made)

    base = base.withColumn("text_h", F.xxhash64("text"))
    dealt = common.stored(items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition("block"), "benchmark")
    passes = []
    for k in range(blocks):
        held, found = searched([tuple(r) for r in dealt.where(F.col("block") == k).select("id", "text").collect()])

        @common.lean
        def only_hit(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            for piece, own, hit, ids in found(batches):
                first = np.cumsum(own.n_words) - own.n_words
                runs = own.runs(hit)
                live = [d for d, r in enumerate(runs) if r]
                at = [[{"first": h - int(first[d]), "last": t - int(first[d])} for h, t in runs[d]] for d in live]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(live, pa.int64())), piece.column(2).take(pa.array(live, pa.int64())), pa.array([ids[d] for d in live], list_of["items"]), pa.array(at, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))], names=["doc_id", "text_h", "items", "runs"])

        passes.append(common.stored(base.select("doc_id", "text", "text_h").mapInArrow(only_hit, "doc_id long, text_h long, items array<string>, runs array<struct<first:long,last:long>>").distinct(), f"contamination-{k}"))
        held.unpersist()
    merged = reduce(DataFrame.unionByName, passes).groupBy("doc_id", "text_h").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"))
    both = base.join(merged, base["doc_id"].eqNullSafe(merged["doc_id"]) & (base["text_h"] == merged["text_h"]), "left")
    both = both.select(base["doc_id"], "text", "items", "runs", *(["row"] if row else []))

    @common.lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.pieces(batch, limit=4 * common.PIECE_BYTES):
                own = Piece(piece.column(1).to_pylist())
                first = np.cumsum(own.n_words) - own.n_words
                edge = np.zeros(len(own.hashes) + 1, np.int64)
                for d, runs in enumerate(piece.column(3).to_pylist()):
                    for r in runs or ():
                        edge[first[d] + r["first"]] += 1
                        edge[first[d] + r["last"] + 1] -= 1
                ids = [sorted(set(x or ())) for x in piece.column(2).to_pylist()]
                yield result(piece, own, np.cumsum(edge[:-1]) > 0, ids, [piece.column(1), piece.column(4)] if row else [])

    return both.mapInArrow(merge, made)


def cut(docs: DataFrame, benchmark: DataFrame, row: bool = False, **options) -> DataFrame:
    """(doc_id, text[, row]): every row of docs with its merged removal spans cut out of the text; null texts become empty ones.

    row, nulls, repeats and empty tables: as for find().
    """
    return _search(docs, benchmark, True, row=row, **options)


def digests(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    found = find(docs, benchmark, **options)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB SQL for the columns of digests, with windows of width words.
SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {documents}),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {benchmark}),
win AS (SELECT DISTINCT item_id, least(len(w), {width}) AS n, array_to_string(list_slice(w, i, i + {width} - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {width} + 1, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
occ AS (SELECT dg.doc_id, dg.i, dg.n, win.item_id FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""


def oracle(documents: str = "documents", benchmark: str = "benchmark", width: int = 10) -> str:
    return SQL.format(documents=documents, benchmark=benchmark, width=width)
