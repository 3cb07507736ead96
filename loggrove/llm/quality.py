"""Quality classifier by compression: how much smaller a text gets with a zstandard dictionary of good text than with one of bad text.

Each whole text is cut into chunks of 1 KB (a long text's own history would drown a dictionary), all chunks are compressed
with both dictionaries, and the summed sizes give the normalised difference. It, the text's size under the better
dictionary, and its size without any (junk that repeats itself) are calibrated to a score by logistic regression on labelled
rows that the dictionaries haven't seen. Lines that sampled documents of both classes hold stay out of the dictionaries: such
shared passages say nothing about a class, but would match whole in the one dictionary that they happened to get into.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled training rows of each class that are read at most: the bound of the fitted sample (those with the least hash of their id).
SAMPLE_ROWS = 4000
#: Share of them that goes into the dictionaries; the others calibrate.
FOR_DICTIONARY = 0.6
CHUNK = 1024
#: Bytes of a dictionary at most, and chunks that one document gives to it.
DICTIONARY_BYTES = 448 << 10
CHUNKS_OF_DOC = 4
LEVEL = 6


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.c_[(features - np.array(self.mean)) / np.array(self.scale), np.ones(len(features))] @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Sizes:
    """Compressors primed with both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        def primed(data: bytes):
            if not data:
                return z.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
            own = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)

        self.good, self.bad, self.none = primed(good), primed(bad), primed(b"")

    def features(self, text: str) -> tuple[float, float, float, float]:
        raw = text.encode()
        if not raw:
            return 0.0, 0.0, 0.0, 0.0
        n = len(raw)
        cut = [raw[i : i + CHUNK] for i in range(0, n, CHUNK)]
        good = sum(len(self.good.compress(c)) for c in cut)
        bad = sum(len(self.bad.compress(c)) for c in cut)
        own = np.log((len(self.none.compress(raw)) + 1) / n)
        return (good - bad) / n, min(good, bad) / n, own, own * own


def dictionary(samples: list[bytes]) -> bytes:
    """Raw content of the samples, as much as fits, evenly thinned; the last ones are the nearest to a text."""
    keep = max(1, DICTIONARY_BYTES // CHUNK)
    step = max(1.0, len(samples) / keep)
    return b"".join(samples[int(i * step)] for i in range(min(keep, len(samples))))[-DICTIONARY_BYTES:]


def calibrate(features: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[tuple, tuple, tuple]:
    """Logistic regression of weighted rows by Newton steps, ridge 1; with one class only, its prior decides."""
    n = np.ones(len(features)) if weights is None else weights
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.c_[(features - mean) / scale, np.ones(len(features))]
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.ones(x.shape[1] - 1), 1e-3]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w = w - np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6), x.T @ (n * (p - labels)) + ridge * w)
    return tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist())


def held_out(doc_id):
    """Rows that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from a bounded sample of labelled rows that aren't held out. Ids with contradicting labels are left out; without labels every score is 0.5.

    Null and empty texts teach nothing; repeated rows of an id teach each time; of equal hashes the smaller ids are taken. An empty table, or
    one class alone, gives a model that scores 0.5 everywhere. A class that the bound cuts weighs in the calibration as much as all its labels, so the threshold doesn't move with the table's size.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").select("doc_id", "quality", F.xxhash64("doc_id").alias("h"))
    total = {r.quality: r.n for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = own.where("quality = 1").orderBy("h", "doc_id").limit(sample_rows).unionByName(own.where("quality = 0").orderBy("h", "doc_id").limit(sample_rows))
    texts = common.as_texts(docs).where("text <> ''").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality", (F.pmod(F.col("h"), F.lit(1000)) < int(1000 * FOR_DICTIONARY)).alias("first"))
    texts = common.stored(texts.withColumn("row", F.monotonically_increasing_id()), "quality-sample")
    lines = texts.select("row", "doc_id", "quality", "first", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    own = lines.groupBy("line").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).where("least = most").select("line")
    told = lines.where("first").join(own, "line").groupBy("row", "doc_id", "quality").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    told = told.select("doc_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), "quality")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, q in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                n = -(-len(raw) // CHUNK)
                at = sorted({int(i * n / CHUNKS_OF_DOC) for i in range(CHUNKS_OF_DOC)})
                yield pa.RecordBatch.from_pydict({"doc_id": [doc] * len(at), "quality": pa.array([q] * len(at), pa.int32()), "at": pa.array(at, pa.int32()), "chunk": pa.array([raw[i * CHUNK : (i + 1) * CHUNK] for i in at], pa.binary())})

    samples: dict[int, list[bytes]] = {0: [], 1: []}
    few = told.mapInArrow(cut, "doc_id long, quality int, at int, chunk binary")
    for q in samples:  # as many chunks as a dictionary holds, whatever the sample
        rows = few.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", "at"), "chunk").limit(DICTIONARY_BYTES // CHUNK).collect()
        samples[q] = [bytes(r.chunk) for r in rows]
    good, bad = dictionary(samples[1]) if samples[1] else b"", dictionary(samples[0]) if samples[0] else b""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            found = [sizes.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"quality": batch.column(1), "f": pa.array([list(f) for f in found], pa.list_(pa.float64()))})

    rows = texts.where("not first").select("text", "quality").mapInArrow(measure, "quality int, f array<double>").collect()
    if not rows or not good or not bad:
        return Model(good, bad, (0.0,) * 4, (1.0,) * 4, (0.0,) * 5)
    weights = np.array([total[r.quality] / min(total[r.quality], sample_rows) for r in rows])
    weights *= len(rows) / weights.sum()
    return Model(good, bad, *calibrate(np.array([r.f for r in rows]), np.array([r.quality for r in rows], dtype=float), weights))


def score(docs: DataFrame, model: Model, row: bool = False) -> DataFrame:
    """(doc_id, score double, predicted int[, text, row]): one pass over the texts; label, language, source and id don't count.

    row: a struct of all other columns of docs, and the text as it came, so none of them can clash with these names. Null texts
    score as empty ones; repeated rows stay, equal texts have equal scores; a score of 0.5 is predicted 1; an empty table gives
    an empty one. The model (two dictionaries of DICTIONARY_BYTES at most) is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    extra = [common.packed(docs, ("text",)).alias("row")] if row else []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            for piece in common.pieces(batch, limit=8 * common.PIECE_BYTES):
                s = model.score(np.array([sizes.features(t or "") for t in piece.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), *(piece.columns[1:] if row else [])], names=made.names)

    made = common.schema("doc_id long, score double, predicted int")
    if row:
        for f in base.schema.fields[1:]:
            made = made.add(f.name, f.dataType)
    return base.mapInArrow(run, made)
