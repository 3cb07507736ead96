"""Byte-pair encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up the rank of every adjacent pair by binary search over the
sorted pair keys, takes each word's lowest rank, and merges all its occurrences from left to right; a word without a known
pair is done and leaves the array. A vocabulary in which a merged symbol only joins in later merges than the one that made
it (checked when it is loaded) makes this equal to merging one pair at a time.

Words repeat, so each worker keeps a bounded table of chunks (what stands between single spaces) that it has encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

NONE = np.int32(2**31 - 1)
#: Chunks that a worker keeps; beyond them it starts afresh.
CACHE_CHUNKS = 400_000
#: A chunk that begins like this is taken as it is, without the space before it; no text holds a lone surrogate.
VERBATIM, SPECIAL = "\ud800", "\ud801"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """The vocabulary as arrays: sorted pair keys with rank, and the symbol that each rank makes."""

    def __init__(self, text: str):
        config = json.loads(text)
        model = config["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in config["added_tokens"]}
        self.size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([self.vocab[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        self.made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int32)
        born = np.full(self.size, -1, dtype=np.int64)
        born[self.made[::-1]] = np.arange(len(pairs))[::-1]
        if (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any() or len(np.unique(self.made)) < len(pairs):
            raise ValueError("a merge of this vocabulary comes before the one that makes its part")
        keys = left * self.size + right
        self.rank = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank]
        symbols = byte_symbols()
        self.first = np.array([self.vocab[s] for s in symbols], dtype=np.int32)
        self.last = np.array([self.vocab[s + self.suffix] for s in symbols], dtype=np.int32)
        self.bytes_of = {s: b for b, s in enumerate(symbols)}
        self.tokens = [""] * self.size
        for s, i in [*self.vocab.items(), *self.added.items()]:
            self.tokens[i] = s

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each word has. Words aren't empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.first[raw]
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), NONE, dtype=np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            over = np.repeat(best == NONE, sizes)
            if over.any():
                done.append((word[over], sym[over]))
                live = ~over
                sym, word, rank, over = sym[live], word[live], rank[live], best == NONE
                best, sizes = best[~over], sizes[~over]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, sizes)
            twice = np.flatnonzero(hit[1:] & hit[:-1])
            if len(twice):  # a a a: every other one of a run of hits merges
                at = np.flatnonzero(hit)
                head = np.r_[True, np.diff(at) > 1]
                since = at - at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
                hit[at[since % 2 == 1]] = False
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            where = np.cumsum(keep) - 1
            touched = where[at]
            sym, word, rank = sym[keep], word[keep], rank[keep]
            near = np.zeros(len(sym) + 1, dtype=bool)
            near[touched] = near[touched - 1] = True  # before the first: the spare last place
            near[-1] = False
            touched = np.flatnonzero(near[:-1])
            rank[touched] = NONE
            if touched[-1] == len(sym) - 1:
                touched = touched[:-1]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched] = self.ranks(sym[touched], sym[touched + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, sym = (np.concatenate([x[i] for x in done]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes whole texts as the tokenizers library does with this vocabulary file; one for each worker process."""

    #: Beyond these characters the library itself splits (its tables of letters may be of another Unicode version).
    LATIN = "\u024f"

    def __init__(self, text: str):
        self.text, self.merges = text, Merges(text)
        self.spaced = not self.merges.suffix  # byte-level: a space belongs to the word after it
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+" if self.spaced else r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
        self.split = regex.compile(split)
        self.odd = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0]")
        self.special = re.compile("|".join(re.escape(s) for s in self.merges.added))
        self._library = None
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {SPECIAL + s: i for i, s in enumerate(self.merges.added)}
        self.ids = np.array(list(self.merges.added.values()), dtype=np.int32)
        self.lengths = np.ones(len(self.ids), dtype=np.int64)
        self.starts = np.arange(len(self.ids), dtype=np.int64)
        self.loose = np.zeros(len(self.ids), dtype=bool)

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.text)
        return self._library

    def words(self, chunk: str) -> list[bytes]:
        """The words of a chunk, each as bytes."""
        if chunk <= "" or (max(chunk) <= self.LATIN and not self.odd.search(chunk)):
            if not self.spaced:
                import unicodedata

                chunk = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
                chunk = "".join(c.lower() for c in chunk) if "İ" in chunk else chunk.lower()
            return [w.encode() for w in self.split.findall(chunk)]
        lib = self.library
        chunk = lib.normalizer.normalize_str(chunk) if lib.normalizer else chunk
        return [bytes(map(self.merges.bytes_of.__getitem__, w)) for w, _ in lib.pre_tokenizer.pre_tokenize_str(chunk)]

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks that aren't in the table yet."""
        words, counts, loose = [], [], []
        lead = " " if self.spaced else ""
        for chunk in chunks:
            if chunk.isalpha() and chunk.isascii():  # one word
                words.append((lead + chunk if lead else chunk.lower()).encode())
                counts.append(1)
                loose.append(False)
                continue
            if chunk[:1] == VERBATIM:
                own, bare = chunk[1:], False
            else:
                own, bare = (" " + chunk, not chunk or chunk[0].isspace() or chunk[-1].isspace()) if self.spaced else (chunk, False)
            found = [] if bare or not own else self.words(own)
            words += found
            counts.append(len(found))
            loose.append(bare)
        ids, lengths = self.merges.encode(words) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        bounds = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)].astype(np.int64)]
        n = len(self.lengths)
        self.index.update(zip(chunks, range(n, n + len(chunks))))
        self.starts = np.r_[self.starts, len(self.ids) + bounds[:-1]]
        self.lengths = np.r_[self.lengths, np.diff(bounds)]
        self.ids = np.r_[self.ids, ids]
        self.loose = np.r_[self.loose, np.array(loose, dtype=bool)]

    def chunks(self, text: str) -> list[str]:
        if "<|" not in text:
            return self._chunks(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._chunks(text[at : m.start()])
            out.append(SPECIAL + m[0])
            at = m.end()
        return out + self._chunks(text[at:])

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        found = text.split(" ")
        if self.spaced:
            if found[0] and not found[0][-1].isspace():
                found[0] = VERBATIM + found[0]
            else:  # white space at the start
                return self.plain(text)
        return found

    def plain(self, text: str) -> list[str]:
        """Word by word, for texts with runs of white space."""
        if max(text) <= self.LATIN and not self.odd.search(text):
            return [VERBATIM + w for w in self.split.findall(text)]
        return [VERBATIM + bytes(map(self.merges.bytes_of.__getitem__, w)).decode(errors="surrogateescape") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def look(self, keys: list[str]) -> np.ndarray:
        missing = list(set(keys) - self.index.keys())
        if missing:
            self.learn(missing)
        return np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        if len(self.index) > CACHE_CHUNKS:
            self.clear()
        each = [self.chunks(t) for t in texts]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        at = self.look([k for x in each for k in x])
        if self.spaced and self.loose[at].any():
            of = np.repeat(np.arange(len(each)), counts)
            for i in np.unique(of[self.loose[at]]).tolist():
                each[i] = self.again(texts[i])
            counts = np.fromiter(map(len, each), np.int64, len(each))
            at = self.look([k for x in each for k in x])
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(total)]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return ids, np.diff(bounds)

    def again(self, text: str) -> list[str]:
        out, at = [], 0
        for m in self.special.finditer(text):
            out += (self.plain(text[at : m.start()]) if m.start() > at else []) + [SPECIAL + m[0]]
            at = m.end()
        return out + (self.plain(text[at:]) if at < len(text) else [])

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary of words has no decoder: its tokens are joined by spaces, special ones included."""
        names = self.merges.tokens
        if self.spaced:
            back = self.merges.bytes_of
            out, run = [], []
            for i in ids.tolist():
                if names[i] in self.merges.added:
                    out += [bytes(run).decode(errors="replace"), names[i]]
                    run = []
                else:
                    run += map(back.__getitem__, names[i])
            return "".join([*out, bytes(run).decode(errors="replace")])
        return " ".join(map(names.__getitem__, ids.tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(text: str) -> Encoder:
    """This worker's encoder for a vocabulary file's text."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(text)
    return _ENCODERS[key]


def vocabulary(spark, path: str):
    """The vocabulary file, broadcast: a fixed size, whatever the input."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): ids of each whole text as little-endian unsigned 32-bit integers. Null and empty texts have none; repeated rows stay."""
    held = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for batch in batches:
            for piece in common.pieces(batch):
                ids, counts = enc.encode(piece.column(1).to_pylist())
                ends = np.cumsum(counts) * 4
                data = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([data[e - 4 * n : e] for e, n in zip(ends.tolist(), counts.tolist())], pa.binary())], names=["doc_id", "ids"])

    return common.as_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids): tokens as the library's decode gives them, special ones included. Null and empty ids are an empty text; repeated rows stay."""
    held = vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for batch in batches:
            for piece in common.pieces(batch, "ids"):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([enc.decode(np.frombuffer(x or b"", "<u4")) for x in piece.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): encodes and decodes in one pass over the texts, without a shuffle.

    Null and empty texts have no ids and decode to nothing; repeated rows stay, equal texts have equal ids; a very long text is
    encoded as a whole; extra columns aren't read; an empty table gives an empty one.
    """
    held = vocabulary(docs.sparkSession, path)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for batch in batches:
            for piece in common.pieces(batch):
                ids, counts = enc.encode(piece.column(1).to_pylist())
                ids_sha, text_sha, raw, at = [], [], [], 0
                for n in counts.tolist():
                    own = ids[at : at + n]
                    at += n
                    data = own.astype("<u4").tobytes()
                    raw.append(data if with_ids else b"")
                    ids_sha.append(hashlib.sha256(data).hexdigest())
                    text_sha.append(hashlib.sha256(enc.decode(own).encode()).hexdigest())
                out = [piece.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(out[: 4 + with_ids], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    return common.as_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
