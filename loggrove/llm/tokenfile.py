"""Token ids on disk: segments of patched frame-of-reference blocks.

A segment holds whole documents in order. Its ids are cut into blocks of 256: the block's minimum is subtracted, the rest is
packed at a width chosen among percentiles of the block's bit lengths (the one that makes it smallest), and what doesn't fit
goes to an exception list. A table of block starts lets a reader unpack any block alone.

Segments are written through Spark's committer into the shared folder (rows part, at, payload), so a lost executor or a
second attempt of a task leaves no half-written file.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

MAGIC = b"PFB1"
BLOCK = 256
#: Widths offered to a block: the bit length at these percentiles of its ids.
PERCENTILES = (50, 75, 90, 97, 100)
#: Ids after which a segment ends with the document that it is in.
SEGMENT_IDS = 1 << 19


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Byte starts of the blocks (and the end), and the blocks: minimum u32, width u8, exceptions u16, packed values, positions u8, high parts u32."""
    n = len(ids)
    nb = -(-n // BLOCK)
    if not nb:
        return np.zeros(1, np.uint32), b""
    full = np.empty(nb * BLOCK, np.int64)
    full[:n] = ids
    full[n:] = ids[-1]
    full = full.reshape(nb, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    bits = np.where(rest > 0, np.frexp(rest.astype(np.float64))[1], 0).astype(np.int64)
    ranked = np.sort(bits, axis=1)
    offered = ranked[:, [min(BLOCK - 1, -(-BLOCK * p // 100) - 1) for p in PERCENTILES]]
    costs = np.stack([BLOCK // 8 * offered[:, j] + 5 * (bits > offered[:, j : j + 1]).sum(axis=1) for j in range(len(PERCENTILES))], axis=1)
    width = offered[np.arange(nb), costs.argmin(axis=1)]
    over = bits > width[:, None]
    packed: list[bytes] = [b""] * nb
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for few in np.array_split(rows, -(-len(rows) // 512)):
            if w == 16:
                data = (rest[few] & 0xFFFF).astype(">u2").view(np.uint8)
            else:
                data = np.packbits((rest[few][:, :, None] >> np.arange(w - 1, -1, -1) & 1).astype(np.uint8).reshape(len(few), -1), axis=1) if w else np.zeros((len(few), 0), np.uint8)
            for r, x in zip(few.tolist(), data):
                packed[r] = x.tobytes()
    out, starts, at = [], np.zeros(nb + 1, np.uint32), 0
    counts = over.sum(axis=1).tolist()
    where = np.split(np.nonzero(over)[1].astype(np.uint8), np.cumsum(counts)[:-1])
    high = np.split((rest >> width[:, None])[over].astype("<u4"), np.cumsum(counts)[:-1])
    for i in range(nb):
        data = struct.pack("<IBH", int(least[i]), int(width[i]), counts[i]) + packed[i] + where[i].tobytes() + high[i].tobytes()
        out.append(data)
        at += len(data)
        starts[i + 1] = at
    return starts, b"".join(out)


def unpack_blocks(starts: np.ndarray, data: bytes, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks first to last (excluded), at most n in all."""
    last = len(starts) - 1 if last is None else last
    out = np.empty((last - first, BLOCK), np.int64)
    heads = [struct.unpack_from("<IBH", data, s) for s in starts[first:last].tolist()]
    width = np.array([h[1] for h in heads], dtype=np.int64)
    raw = np.frombuffer(data, np.uint8)
    begin = starts[first:last].astype(np.int64) + 7
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for few in np.array_split(rows, -(-len(rows) // 512)):
            took = raw[begin[few][:, None] + np.arange(BLOCK // 8 * w)]
            if w == 16:
                out[few] = np.ascontiguousarray(took).view(">u2")
            elif w:
                out[few] = np.unpackbits(took, axis=1).reshape(len(few), BLOCK, w) @ (1 << np.arange(w - 1, -1, -1, dtype=np.int64))
            else:
                out[few] = 0
    for i, (low, w, k) in enumerate(heads):
        if k:
            at = int(begin[i]) + BLOCK // 8 * w
            out[i, np.frombuffer(data, np.uint8, k, at)] += np.frombuffer(data, "<u4", k, at + k).astype(np.int64) << w
        out[i] += low
    return out.ravel()[: max(0, n - first * BLOCK)].astype(np.uint32)


def write_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: head, document ids, null flags, counts, block starts, blocks."""
    starts, blocks = pack_blocks(ids)
    head = MAGIC + struct.pack("<IQI", len(doc_ids), len(ids), len(starts) - 1)
    known = np.array([d if d is not None else 0 for d in doc_ids], dtype="<i8")
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    return b"".join((head, known.tobytes(), null.tobytes(), counts.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), blocks))


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, n, nb = struct.unpack_from("<IQI", data, 4)
    at = 20
    known = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    starts = np.frombuffer(data, "<u4", nb + 1, at)
    ids = unpack_blocks(starts, data[at + 4 * (nb + 1) :], n) if nb else np.zeros(0, np.uint32)
    return [None if z else d for d, z in zip(known.tolist(), null.tolist())], counts, ids


class Fast:
    """The byte-level vocabulary for tiktoken, whose ids are those of the tokenizers library (ids rise with merge rank); texts that it refuses go to bpe.Encoder."""

    def __init__(self, text: str):
        import tiktoken

        config = json.loads(text)
        back = {s: b for b, s in enumerate(bpe.byte_symbols())}
        vocab = config["model"]["vocab"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in config["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("the ids of this vocabulary don't rise with merge rank")
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        special = {x["content"]: x["id"] for x in config["added_tokens"]}
        self.own = tiktoken.Encoding("bytes", pat_str=split, mergeable_ranks={bytes(map(back.__getitem__, s)): i for s, i in vocab.items() if s not in special}, special_tokens=special)
        self.text = text

    def encode(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.own.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
        except BaseException as why:  # its Rust panics aren't Exceptions
            if isinstance(why, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return bpe.encoder(self.text).encode([text])[0].astype(np.uint32)


_FAST: dict[int, Fast] = {}


def write(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes docs in ascending order of id (nulls first; rows of one id by their text), each with end_id after it.

    Null and empty texts have no other id; repeated rows stay; extra columns aren't read. Returns the stored segments (part, at, n_ids, payload): part numbers the ranges of ids, at counts a part's ids before the segment.
    Texts are shuffled once, by range, and sorted within a part; ids only travel into the files.
    """
    spark = docs.sparkSession
    held = bpe.vocabulary(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _FAST.get(0) or _FAST.setdefault(0, Fast(held.value))
        if enc.text != held.value:
            enc = _FAST[0] = Fast(held.value)
        end = np.array([end_id], np.uint32)
        part, at, waiting, ids, size = 0, 0, [], [], 0

        def segment() -> pa.RecordBatch:
            flat = np.concatenate([x for pair in ids for x in (pair, end)])
            data = write_segment(waiting, np.array([len(x) + 1 for x in ids]), flat)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "at": pa.array([at], pa.int64()), "n_ids": pa.array([len(flat)], pa.int64()), "payload": pa.array([data], pa.binary())})

        for batch in batches:
            for piece in common.pieces(batch):
                for own, doc, text in zip(piece.column(2).to_pylist(), piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    part = own
                    waiting.append(doc)
                    ids.append(enc.encode(text))
                    size += len(ids[-1]) + 1
                    if size >= SEGMENT_IDS:
                        yield segment()
                        at, waiting, ids, size = at + size, [], [], 0
        if waiting:
            yield segment()

    ordered = common.as_texts(docs, id_col, text_col).repartitionByRange(common.parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, "part int, at long, n_ids long, payload binary")
    return common.stored(made, "token-segments")


def read(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone. start counts all ids before the document.

    Documents without text have their end id alone; rows of one id follow each other; an empty table gives an empty one.
    The totals of the parts (one small row for each range) are summed in order; their number is that of the write's tasks, so their join may be broadcast.
    """
    from pyspark.sql import Window

    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start = batch.column(0)[i].as_py()
                doc_ids, counts, ids = read_segment(batch.column(1)[i].as_py())
                ends = np.cumsum(counts)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + ends - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    placed = segments.join(F.broadcast(before), "part").select((F.col("before") + F.col("at")).alias("start"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
