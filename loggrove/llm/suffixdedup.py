"""Removal of repeated byte strings: suffixes sorted by bucket-pointer refinement, where a string can repeat at all.

A byte goes if a string of `least` bytes (100) that covers it also starts earlier: in a smaller document, or earlier in the
same one. Sorting all suffixes of a corpus together isn't needed for that. Every such string holds the least of its q-gram
hashes (an anchor, about one for 40 bytes), which its content alone chooses, so equal strings have equal anchors:

1. each document gives its anchors: hash of the q-gram, 128-bit hash of all bytes of the strings that belong to the anchor;
2. anchors meet by their q-gram, dealt in packed blobs. An anchor whose q-gram is unique is done; one with the same bytes as
   an earlier one is repeated as a whole; the rest must be compared;
3. those send their bytes (the strings that belong to the anchor, 100 to 180 bytes);
4. the bytes of one q-gram are sorted: initial buckets of 25-grams are refined by the bucket numbers of later offsets (25 and
   then 50 further on), the new numbers being used again in the next round, and buckets of one suffix are left out. In each
   bucket of equal 100-byte strings all but the earliest are repeated;
5. the repeated starts of a document are merged and cut out of its bytes.

A q-gram that is very frequent in one piece of input isn't gathered: the piece sends a mark instead of its rows, and the
strings of such anchors are dealt by their own 128-bit hash after the piece has kept the earliest of equal ones. So a passage
that a third of all documents share costs a few rows for each piece, in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 100
GRAM = 20
#: Rows of one q-gram that a piece of input sends to one place at most, and anchors that a piece has.
OFTEN = 4
PIECE_ANCHORS = 200_000
#: String starts that are hashed together; a longer document is cut into parts that overlap.
PART = 1 << 19
#: Rows of one q-gram from which they are dealt by string.
HOT = 100_000
#: Bytes of text whose anchors meet in one bucket, about: a worker holds one bucket at a time.
BUCKET_BYTES = 64 << 20
MULTIPLIER = 0x9E3779B97F4A7C15 | 1

ANCHOR = (("h", "<u8"), ("c", "<u8"), ("c2", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("p", "<u4"), ("n", "u1"), ("off", "u1"))
WHOLE = (("doc", "<i8"), ("th", "<i8"), ("p", "<u4"), ("n", "<u4"))
DEFER = (("h", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("p", "<u4"), ("n", "u1"), ("off", "u1"))
MARK = (("h", "<u8"),)
BYTES = (("h", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("p", "<u4"), ("n", "u1"))
STRINGS = (("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("p", "<u4"))
KINDS = {1: ANCHOR, 2: WHOLE, 3: DEFER, 4: MARK, 5: BYTES, 6: STRINGS}


def pack(kind: int, columns: dict[str, np.ndarray], tail: bytes = b"") -> bytes:
    n = len(columns[KINDS[kind][0][0]])
    body = b"".join(np.ascontiguousarray(columns[c].astype(t)).tobytes() for c, t in KINDS[kind]) + tail
    return bytes([kind]) + n.to_bytes(4, "little") + zstandard.compress(body, 1)


def unpack(blob: bytes) -> tuple[int, dict[str, np.ndarray], bytes]:
    kind, n = blob[0], int.from_bytes(blob[1:5], "little")
    body, at, out = zstandard.decompress(blob[5:]), 0, {}
    for c, t in KINDS[kind]:
        out[c] = np.frombuffer(body, t, n, at)
        at += n * np.dtype(t).itemsize
    return kind, out, body[at:]


def joined(parts: list[dict[str, np.ndarray]], kind: int) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, t) for c, t in KINDS[kind]}


def dealt(k: np.ndarray, kind: int, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """The rows as one blob for each k."""
    order = np.argsort(k, kind="stable")
    k = k[order]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(k)]):
        yield int(k[s]), pack(kind, {c: v[order[s:e]] for c, v in columns.items()})


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        m = max(n, 1 << 20)
        for name, base in (("up", MULTIPLIER), ("down", pow(MULTIPLIER, -1, 1 << 64))):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Hashes:
    """Hashes of the ranges of one length of raw."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.upto = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.upto[1:])

    def all(self, length: int) -> np.ndarray:
        n = len(self.upto) - length
        return mixed((self.upto[length:] - self.upto[:n]) * self.down[:n])


def anchors(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> dict[str, np.ndarray]:
    """Anchors of texts that lie one after the other in raw: text, first string start p (in raw), number of further starts n, offset of the anchor from p, hash h of the q-gram, and the halves c and c2 of the hash of the strings' bytes."""
    gram = min(GRAM, least)
    width = least - gram + 1
    valid = np.maximum(lengths - least + 1, 0)
    none = {c: np.zeros(0, np.int64) for c in ("text", "p", "n", "off")} | {c: np.zeros(0, np.uint64) for c in ("h", "c", "c2")}
    if not valid.any():
        return none
    ranges = Hashes(raw)
    h = ranges.all(gram)
    bits = max(1, int(len(h)).bit_length())
    low = np.uint64((1 << bits) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equals
    rows = -(-len(key) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(key)] = key
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    text = np.repeat(np.arange(len(starts)), valid)
    p = np.repeat(starts - np.cumsum(valid) + valid, valid) + np.arange(len(text))
    at = (np.minimum(ahead[p], behind[p + width - 1]) & low).astype(np.int64)
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    n = np.diff(np.r_[head, len(at)]) - 1
    p, at, text = p[head], at[head], text[head]
    long = n > 200  # can't be: a window has fewer starts
    assert not long.any()
    data = memoryview(raw)
    own = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[s:e]) for s, e in zip(p.tolist(), (p + n + least).tolist())), "<u8").reshape(-1, 2)
    return {"text": text, "p": p, "n": n, "off": at - p, "h": h[at], "c": own[:, 0], "c2": own[:, 1]}


def parts_of(texts: list[bytes], least: int, limit: int = PART) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of about limit bytes: row, first byte and bytes of each part of a text."""
    row, first, data, size = [], [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - least + 1), limit):
            own = t[s : s + limit + least - 1]
            if data and size + len(own) > limit:
                yield row, first, data
                row, first, data, size = [], [], [], 0
            row.append(i), first.append(s), data.append(own)
            size += len(own)
    if data:
        yield row, first, data


def first_of(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorts by keys, then order: the sorting, and whether a row's keys equal those of the row before it."""
    by = np.lexsort([*order[::-1], *keys[::-1]])
    same = np.ones(max(0, len(by) - 1), dtype=bool)
    for k in keys:
        same &= k[by][1:] == k[by][:-1]
    return by, np.r_[False, same] if len(by) else np.zeros(0, dtype=bool)


def runs(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Starts p to p + n, merged where they follow each other in a document."""
    by = np.lexsort((columns["p"], columns["th"], columns["doc"]))
    doc, th, p, n = (columns[c][by].astype(np.int64) for c in ("doc", "th", "p", "n"))
    if not len(by):
        return {"doc": doc, "th": th, "p": p, "n": n}
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (p[1:] > (p + n)[:-1] + 1)])
    last = np.maximum.reduceat(p + n, head)
    return {"doc": doc[head], "th": th[head], "p": p[head], "n": last - p[head]}


def local(a: dict[str, np.ndarray], most: int = OFTEN) -> tuple[dict, dict, dict, np.ndarray]:
    """Of a piece's anchors: repeats of a whole anchor within the piece; rows to deal by string; rows to meet; marks of frequent q-grams."""
    by, same = first_of([a["h"], a["c"], a["c2"]], [a["doc"], a["th"], a["p"]])
    whole = {c: a[c][by[same]] for c in ("doc", "th", "p", "n")}
    left = {c: v[by[~same]] for c, v in a.items()}
    head = np.r_[True, left["h"][1:] != left["h"][:-1]] if len(left["h"]) else np.zeros(0, dtype=bool)
    count = np.diff(np.r_[np.flatnonzero(head), len(head)])
    often = np.repeat(count > most, count)
    return whole, {c: v[often] for c, v in left.items()}, {c: v[~often] for c, v in left.items()}, left["h"][head][count > most]


def refine(raw: np.ndarray, p: np.ndarray, least: int) -> np.ndarray:
    """Numbers of the strings of `least` bytes at each p, equal for equal strings; -1 where no other suffix shares its first buckets.

    Bucket-pointer refinement: buckets of q-grams first (q a quarter of least), then by the bucket number q further on, then 2q.
    """
    q = least // 4
    tail = least - 4 * q
    gram = q + tail  # the last q-gram covers the rest: offsets stay multiples of q
    view = np.lib.stride_tricks.sliding_window_view(raw, gram)
    need = np.unique((p[:, None] + np.arange(4) * q).ravel())
    first = np.zeros(len(raw), np.int64)
    # buckets of whole q-grams, compared byte by byte in words of 8
    size = -(-gram // 8) * 8
    words = np.zeros((len(need), size), np.uint8)
    words[:, :gram] = view[need]
    words = words.view(">u8")
    number = np.zeros(len(need), np.int64)
    for j in range(words.shape[1]):
        column = np.unique(words[:, j], return_inverse=True)[1]
        number = np.unique(number * (len(need) + 1) + column, return_inverse=True)[1] if j else column
    counts = np.bincount(number)
    first[need] = np.where(counts[number] > 1, number, -1)
    live = (first[p[:, None] + np.arange(4) * q] >= 0).all(axis=1)
    out = np.full(len(p), -1, np.int64)
    own = p[live]
    if not len(own):
        return out
    near = np.unique(np.r_[own, own + 2 * q])
    pairs = np.unique(first[near] * (len(raw) + 1) + first[near + q], return_inverse=True)[1]
    second = np.zeros(len(raw), np.int64)
    second[near] = pairs
    out[live] = np.unique(second[own] * (len(raw) + 1) + second[own + 2 * q], return_inverse=True)[1]
    return out


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs of each k, of rows that are sorted by it."""
    now, blobs = None, []
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if k != now and blobs:
                yield now, blobs
                blobs = []
            now = k
            blobs.append(blob.as_py())
    if blobs:
        yield now, blobs


def _rows(columns: dict[str, np.ndarray], kind: int) -> pa.RecordBatch:
    n = len(columns["doc"])
    h = columns["h"].view(np.int64) if "h" in columns else np.zeros(n, np.int64)
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(columns["doc"].astype(np.int64)), "th": pa.array(columns["th"].astype(np.int64)), "p": pa.array(columns["p"].astype(np.int64)), "n": pa.array(columns["n"].astype(np.int64)), "h": pa.array(h), "kind": pa.array(np.full(n, kind, np.int32))})


ROWS = "doc_id long, th long, p long, n long, h long, kind int"


def repeats(docs: DataFrame, least: int = LEAST, often: int = OFTEN, hot: int = HOT, part: int = PART, piece_anchors: int = PIECE_ANCHORS, n_bytes: int = 0) -> DataFrame:
    """(doc_id, th, p, n): starts p to p + n of strings that also start earlier, for docs (doc_id not null, th, text) of n_bytes in all."""
    spark = docs.sparkSession
    buckets = max(4 * common.parts(spark), -(-n_bytes // BUCKET_BYTES))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict[str, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            whole, defer, meet, marks = local(joined(waiting, 1), often)
            waiting.clear()
            out = [*dealt((meet["h"] % np.uint64(buckets)).astype(np.int64), 1, meet), *dealt((marks % np.uint64(buckets)).astype(np.int64), 4, {"h": marks})]
            merged = runs(whole)
            for kind, x in ((2, merged), (3, defer)):
                out += dealt((x["doc"].astype(np.int64) * 7919 + x["p"].astype(np.int64) // 4096) % buckets, kind, x)
            if out:
                yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})

        n = 0
        for batch in batches:
            ids, ths = np.array(batch.column(0).to_pylist(), np.int64), np.array(batch.column(1).to_pylist(), np.int64)
            for row, first, data in parts_of([t.encode() for t in batch.column(2).to_pylist()], least, part):
                lengths = np.array([len(x) for x in data])
                starts = np.cumsum(lengths) - lengths
                a = anchors(np.frombuffer(b"".join(data), np.uint8), starts, lengths, least)
                text = a.pop("text")
                of = np.array(row)[text]
                a["p"] = a["p"] - starts[text] + np.array(first)[text]
                waiting.append(a | {"doc": ids[of], "th": ths[of]})
                n += len(text)
                if n >= piece_anchors:
                    yield from send()
                    n = 0
        if waiting:
            yield from send()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_key(batches):
            got: dict[int, list] = {1: [], 2: [], 3: [], 4: []}
            for b in blobs:
                kind, columns, _ = unpack(b)
                got[kind].append(columns)
            for kind, out in ((2, 0), (3, 2)):
                if got[kind]:
                    yield _rows(joined(got[kind], kind), out)
            a = joined(got[1], 1)
            if not len(a["h"]):
                continue
            by, same = first_of([a["h"], a["c"], a["c2"]], [a["doc"], a["th"], a["p"]])
            if same.any():
                yield _rows(runs({c: a[c][by[same]] for c in ("doc", "th", "p", "n")}), 0)
            left = {c: v[by[~same]] for c, v in a.items()}
            head = np.r_[True, left["h"][1:] != left["h"][:-1]]
            count = np.diff(np.r_[np.flatnonzero(head), len(head)])
            count = np.repeat(count, count)
            frequent = np.isin(left["h"], joined(got[4], 4)["h"]) | (count > hot)
            for kind, those in ((1, (count > 1) & ~frequent), (2, frequent)):
                if those.any():
                    yield _rows({c: v[those] for c, v in left.items()}, kind)

    found = docs.select("doc_id", "th", "text").mapInArrow(find, "k int, blob binary").repartition(common.parts(spark), "k").sortWithinPartitions("k")
    marks = common.stored(found.mapInArrow(meet, ROWS), "suffix-marks")

    def send_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain: list[tuple] = []
        data: list[bytes] = []
        strings: dict[bytes, tuple] = {}
        done: list[tuple] = []

        def send() -> Iterator[pa.RecordBatch]:
            out = []
            if plain:
                columns = dict(zip(("h", "doc", "th", "p", "n"), (np.array(x, t) for x, t in zip(zip(*plain), ("u8", "i8", "i8", "u4", "u1")))))
                k = (columns["h"] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(k, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(k[order])) + 1):
                    out.append((int(k[own[0]]), pack(5, {c: v[own] for c, v in columns.items()}, b"".join(data[i] for i in own.tolist()))))
            if strings:
                digests = np.frombuffer(b"".join(strings), "<u8").reshape(-1, 2)
                columns = dict(zip(("doc", "th", "p"), (np.array(x, np.int64) for x in zip(*strings.values())))) | {"a": digests[:, 0], "b": digests[:, 1]}
                out += dealt((columns["a"] % np.uint64(buckets)).astype(np.int64), 6, columns)
            if done:
                columns = dict(zip(("doc", "th", "p"), (np.array(x, np.int64) for x in zip(*done))))
                merged = runs(columns | {"n": np.zeros(len(done), np.int64)})
                out += dealt(merged["doc"] % buckets, 2, merged)
            for x in (plain, data, strings, done):
                x.clear()
            if out:
                yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})

        for batch in batches:
            for piece in common.pieces(batch):
                for doc, th, text, ps, ns, hs, kinds in zip(*(c.to_pylist() for c in piece.columns)):
                    raw = text.encode()
                    for p, n, h, kind in zip(ps, ns, hs, kinds):
                        if kind == 1:
                            plain.append((h % (1 << 64), doc, th, p, n))
                            data.append(raw[p : p + n + least])
                            continue
                        for i in range(p, p + n + 1):
                            d, own = xxhash.xxh3_128_digest(raw[i : i + least]), (doc, th, i)
                            before = strings.get(d)
                            if before is None or own < before:
                                strings[d] = own
                                own = before
                            if own:
                                done.append(own)
                if len(plain) > 50_000 or len(strings) + len(done) > 300_000:
                    yield from send()
        yield from send()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_key(batches):
            got: dict[int, list] = {2: [], 5: [], 6: []}
            raws = []
            for b in blobs:
                kind, columns, tail = unpack(b)
                got[kind].append(columns)
                if kind == 5:
                    raws.append(tail)
            if got[2]:
                yield _rows(joined(got[2], 2), 0)
            if got[6]:
                s = joined(got[6], 6)
                by, same = first_of([s["a"], s["b"]], [s["doc"], s["th"], s["p"]])
                if same.any():
                    yield _rows(runs({c: s[c][by[same]] for c in ("doc", "th", "p")} | {"n": np.zeros(same.sum(), np.int64)}), 0)
            if got[5]:
                x = joined(got[5], 5)
                n = x["n"].astype(np.int64)
                sizes = n + least
                starts = np.cumsum(sizes) - sizes
                of = np.repeat(np.arange(len(n)), n + 1)
                step = np.arange(len(of)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
                number = refine(np.frombuffer(b"".join(raws), np.uint8), starts[of] + step, least)
                live = np.flatnonzero(number >= 0)
                of, step, number = of[live], step[live], number[live]
                doc, th, p = x["doc"][of], x["th"][of], x["p"][of].astype(np.int64) + step
                by, same = first_of([number], [doc, th, p])
                if same.any():
                    again = by[same]
                    yield _rows(runs({"doc": doc[again], "th": th[again], "p": p[again], "n": np.zeros(len(again), np.int64)}), 0)

    lists = marks.where("kind > 0").groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("p", "n", "h", "kind"))).alias("x"))
    wanted = docs.join(lists, ["doc_id", "th"]).select("doc_id", "th", "text", "x.p", "x.n", "x.h", "x.kind")
    sent = wanted.mapInArrow(send_bytes, "k int, blob binary").repartition(common.parts(spark), "k").sortWithinPartitions("k")
    compared = sent.mapInArrow(compare, ROWS)
    return marks.where("kind = 0").unionByName(compared).select("doc_id", "th", "p", "n")


def remove(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True, **tuning: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of every row.

    Null and empty texts have no bytes; texts shorter than `least` lose none. Rows with neither another id nor another text
    count as one document and get the same result; rows of one id with other texts are ordered by a hash of the text; rows
    without an id come first. Extra columns aren't read; an empty table gives an empty one. Texts are shuffled once.
    """
    base = common.as_texts(docs, id_col, text_col)
    held = base.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).agg(F.max("n").alias("most"), F.sum("size").alias("size")).first()
    # the lowest bit of th says that the row has no id
    th = F.xxhash64("text") if (held["most"] or 0) > 1 else F.lit(0).cast("long")
    th = th.bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    base = base.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), th.alias("th"), "text")
    found = repeats(base, least, n_bytes=held["size"] or 0, **tuning).groupBy("doc_id", "th").agg(F.collect_list("p").alias("p"), F.collect_list("n").alias("n"))
    # both joins with the texts need the same columns in the same places, so they share one exchange
    joined_ = base.join(found, ["doc_id", "th"], "left").select("doc_id", "th", "text", "p", "n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.pieces(batch, limit=4 * common.PIECE_BYTES):
                out = []
                for doc, th, text, p, n in zip(*(c.to_pylist() for c in piece.columns)):
                    raw = text.encode()
                    kept, gone, count, at = [], 0, 0, 0
                    for s, e in sorted((s, s + m + least) for s, m in zip(p or (), n or ())):
                        if s > at or not count:
                            kept.append(raw[at:s])
                            gone += e - s
                            count += 1
                            at = e
                        elif e > at:
                            gone += e - at
                            at = e
                    data = b"".join([*kept, raw[at:]])
                    out.append((None if th & 1 else doc, len(raw), gone, count, hashlib.sha256(data).hexdigest(), data))
                columns = list(zip(*out))
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + keep_bytes], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_bytes])

    return joined_.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
