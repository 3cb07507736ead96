"""Secret scan: fixed patterns, and strings in a sensitive context that a primed compressor can't shorten.

Base kinds are found by pattern. Beside them, a candidate is a run of key characters with letters and digits that follows a
sensitive word in its statement (up to a line's end, a semicolon, a brace or a sentence's end; a label that ends in a colon or
the like reaches into the next line). Its novelty is the bytes that it adds to its compressed surroundings, under a zstandard
dictionary of the identifiers and the pieces of code that stand in such statements anywhere in the corpus: ordinary
identifiers and repeated code add next to nothing, random material adds most of its length.

Texts are read once: the pass finds base spans, candidates with their surroundings, and counts for the dictionaries, which
are written to the shared folder; the candidates are measured from there.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "novel")
#: Fixed pattern of the base kind assign: either case of ASCII letters in the name, a value of 8 characters or more.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A word that makes what follows in its statement sensitive, and lower-case strings one of which each match holds.
CONTEXT = re.compile(r"(?ai:secret|token|passw|passphrase|pwd|api.?key|private|credential|bearer|authoriz|session|signature|client.?id|\bkey\b)")
CONTEXT_HINTS = ("secret", "token", "passw", "passphrase", "pwd", "api", "private", "credential", "bearer", "authoriz", "session", "signature", "client", "key")
#: Where a statement ends, and what lets it go on in the next one.
END = re.compile(r"[\n;{}]|[.!?](?=\s)")
GOES_ON = re.compile(r"(?::|=|\||>|-----)\s*$")
#: Characters of a candidate at least; one shorter than LONG needs lower case, upper case and digits.
LEAST, LONG = 8, 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Characters on both sides that prime the compressor for a candidate.
AROUND = 1500
#: Compressed bytes that a candidate adds for each of its characters at least.
NOVELTY = 0.6
#: Bytes of each of the two dictionaries at most, and of one piece of code in it.
DICTIONARY_BYTES = 32 << 10
CODE_BYTES = 96
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,31}")
#: What looks like random material stays out of the dictionaries, for a secret that is copied must not hide itself.
RANDOM = re.compile(r"[A-Za-z]+[0-9]+[A-Za-z]+[0-9]|[0-9a-fA-F]{16}")
#: Entries of the counts that a task holds before it sends them on.
COUNTS = 200_000


def base_spans(text: str, lower: str | None = None) -> list[tuple[int, int, int, str]]:
    """Base spans (start, order of kind, end, kind) by start, then kind; failing matches are dropped and not tried again."""
    lower = text.lower() if lower is None else lower
    out = []
    if ("=" in text or ":" in text) and any(h in lower for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out)


def statements(text: str, lower: str | None = None) -> Iterator[tuple[int, int, int]]:
    """(start, end, end of the first sensitive word) of each statement that holds a sensitive word, in order; a label's next statement is its own."""
    lower = text.lower() if lower is None else lower
    if not any(h in lower for h in CONTEXT_HINTS):
        return
    words = [m.end() for m in CONTEXT.finditer(text)]
    if not words:
        return
    ends = [m.start() for m in END.finditer(text)]
    done = -1
    for w in words:
        if w <= done:
            continue
        k = bisect_right(ends, w - 1)
        start = ends[k - 1] + 1 if k else 0
        end = ends[k] if k < len(ends) else len(text)
        while k + 1 <= len(ends) and end < len(text) and GOES_ON.search(text, max(w, end - 80), end):
            k += 1
            end = ends[k] if k < len(ends) else len(text)
        yield start, end, w
        done = end


def fit_to_be_one(own: str) -> bool:
    if len(own) < LEAST or not any(c.isdigit() for c in own) or not any(c.isalpha() for c in own):
        return False
    return len(own) >= LONG or (any(c.islower() for c in own) and any(c.isupper() for c in own))


def candidates(text: str, base: list[tuple], lower: str | None = None) -> Iterator[tuple[int, int]]:
    """A run is cut after each = but its padding, so that the name of NAME=value is the value's context; where its last piece is none, the whole run may be one."""
    starts = [b[0] for b in base]

    def sensitive(s: int, e: int, word: int) -> bool:
        if s < word or not fit_to_be_one(text[s:e]):
            return False
        k = bisect_right(starts, e - 1)  # base spans that begin before e
        return not any(s < b[2] for b in base[max(0, k - 3) : k]) and not (k > 3 and any(s < b[2] for b in base[: k - 3]))

    for start, end, word in statements(text, lower):
        for m in CANDIDATE.finditer(text, start, end):
            s, e = m.span()
            if e <= word:
                continue
            cuts = [s, *(s + i + 1 for i, c in enumerate(m[0].rstrip("=")) if c == "=")]
            pieces = [(a, b) for a, b in zip(cuts, [*(c - 1 for c in cuts[1:]), e]) if sensitive(a, b, word)]
            if (not pieces or pieces[-1][1] < e) and sensitive(s, e, word):
                pieces = [(s, e)]
            yield from pieces


class Novelty:
    def __init__(self, known: bytes):
        import zstandard as z

        own = z.ZstdCompressionDict(known, dict_type=z.DICT_TYPE_RAWCONTENT) if known else None
        if own:
            own.precompute_compress(level=9)  # else each compression would digest the dictionary anew
            self.zip = z.ZstdCompressor(dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)
        else:
            self.zip = z.ZstdCompressor(level=9, write_checksum=False, write_content_size=False)

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes that the candidate adds to its compressed surroundings, for each of its bytes."""
        around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).encode()
        own = text[start:end].encode()
        return (len(self.zip.compress(around + own)) - len(self.zip.compress(around))) / len(own)


def surroundings(text: str, found: list[tuple[int, int]]) -> list[dict]:
    """Passages (at, text, spans) of the text that hold all that is within AROUND characters of a candidate; overlapping ones are one."""
    out: list[dict] = []
    high = -1
    for s, e in found:
        low = max(0, s - AROUND)
        if low > high:
            out.append({"at": low, "spans": []})
        high = max(high, e + AROUND)
        out[-1]["spans"].append({"start": s, "end": e})
        out[-1]["high"] = high
    return [{"at": p["at"], "text": text[p["at"] : p["high"]], "spans": p["spans"]} for p in out]


def pieces_of_code(statement: str) -> Iterator[str]:
    """The statement with single blanks and without random material, cut at blanks into pieces of about CODE_BYTES."""
    now = ""
    for word in RANDOM.sub(" ", statement).split():
        if now and len(now) + len(word) >= CODE_BYTES:
            yield now
            now = ""
        now = f"{now} {word}" if now else word[:CODE_BYTES]
    if now:
        yield now


def counted(text: str, counts: Counter, lower: str | None = None) -> None:
    """Adds the identifiers (kind 0) and pieces of code (kind 1) of the sensitive statements."""
    for start, end, _ in statements(text, lower):
        own = text[start:end]
        counts.update((0, x) for x in IDENTIFIER.findall(own) if not RANDOM.search(x))
        counts.update((1, x) for x in pieces_of_code(own))


def dictionary(counts: DataFrame, limit: int = DICTIONARY_BYTES) -> bytes:
    """The most frequent pieces of code, then the most frequent identifiers, of counts (kind, word, n) over all documents."""
    out = b""
    total = counts.groupBy("kind", "word").agg(F.sum("n").alias("n")).where("n > 1")
    for kind in (1, 0):  # what is nearest to the text comes last
        rows = total.where(F.col("kind") == kind).orderBy(F.desc("n"), "word").limit(limit // 4).select("word").collect()
        words, size = [], 0
        for r in rows:
            size += len(r.word.encode()) + 1
            if size > limit:
                break
            words.append(r.word)
        out += ("\n" if kind else " ").join(reversed(words)).encode() + b"\n" * bool(words)
    return out


SPANS = "array<struct<start:int,end:int,kind:string,base:boolean>>"
PASSAGES = "array<struct<at:int,text:string,spans:array<struct<start:int,end:int>>>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty: float = NOVELTY) -> DataFrame:
    """(doc_id, found array of (start, end, kind, base)) of each whole text, by start, then kind; offsets in characters, end exclusive.

    Null and empty texts have none; repeated rows stay, each with the same result; extra columns aren't read, so their names
    can't clash; an empty table gives an empty one. A very long text or line costs time in proportion to its length. One pass
    over the texts, no shuffle of texts; only words of sensitive statements are shuffled, counted by task first.
    """
    texts = common.as_texts(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))
    passage = pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))

    def rows(size: int, **columns) -> pa.RecordBatch:
        types = {"doc_id": pa.int64(), "found": kind, "passages": passage, "kind": pa.int32(), "word": pa.string(), "n": pa.int64()}
        return pa.RecordBatch.from_pydict({c: pa.array(columns.get(c, [None] * size), t) for c, t in types.items()})

    def sent(counts: Counter) -> pa.RecordBatch:
        out = rows(len(counts), kind=[k for k, _ in counts], word=[w for _, w in counts], n=list(counts.values()))
        counts.clear()
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for piece in common.pieces(batch, limit=4 * common.PIECE_BYTES):
                found, passages = [], []
                for text in piece.column(1).to_pylist():
                    lower = text.lower()
                    base = base_spans(text, lower)
                    found.append([{"start": s, "end": e, "kind": k, "base": True} for s, _, e, k in base])
                    passages.append(surroundings(text, sorted(candidates(text, base, lower))))
                    counted(text, counts, lower)
                yield rows(piece.num_rows, doc_id=piece.column(0).to_pylist(), found=found, passages=passages)
                if len(counts) > COUNTS:
                    yield sent(counts)
        yield sent(counts)

    scanned = common.stored(texts.mapInArrow(read, f"doc_id long, found {SPANS}, passages {PASSAGES}, kind int, word string, n long"), "secrets")
    held = docs.sparkSession.sparkContext.broadcast(dictionary(scanned.where("kind is not null").select("kind", "word", "n")))
    order = {k: i for i, k in enumerate(KINDS)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novel = Novelty(held.value)
        for batch in batches:
            out = []
            for found, passages in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                more = [x for p in passages for x in p["spans"] if novel.of(p["text"], x["start"] - p["at"], x["end"] - p["at"]) >= novelty]
                found += [{"start": x["start"], "end": x["end"], "kind": "novel", "base": False} for x in more]
                out.append(sorted(found, key=lambda x: (x["start"], order[x["kind"]])) if more else found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "found"])

    return scanned.where("kind is null").select("doc_id", "found", "passages").mapInArrow(measure, f"doc_id long, found {SPANS}")


def digests(docs: DataFrame, **options) -> DataFrame:
    found = scan(docs, **options)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    n = [count(k) for k in KINDS[:3]]
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *n, F.sha2(text(F.filter("found", lambda x: x["base"])), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
