"""Each operator against a brute-force version, an exact round trip or held-out accuracy; then the odd cases of every one."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loggrove.llm import bpe, common, contamination, linededup, neardup, pii, quality, queries, secrets, suffixdedup, tokenfile, vectors

SF = "/root/testdata/sf0.001"
WORD, BYTE = queries.vocabulary_path("word_bpe_49k.json"), queries.vocabulary_path("byte_bpe_50k.json")
ODD_TEXTS = ["", "  a  b ", "\n\n x\t\ty  ", "Hello <|endoftext|> wörld's  İ 123 ﷺ ½ é́ 日本", "<|startoftext|><|endoftext|>", "ΑΣ ΣΑΣ. aΣ", "x" * 5000, "a\x1cb\x85c", "don't I'LL we'Ve", "aaaa aaaaa", "🎉 é ﬁ Ǆ", "￾ a ￿", "\x00", "मिलते हैं 한국어", "<|endoftext|", "\r\n\r\n  \r\n a", " " * 3000]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(spark):
    return {r.doc_id: r.text for r in documents(spark).select("doc_id", "text").collect()}


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def unite(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# token ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_bpe_equals_the_library(spark, path):
    rng = random.Random(1)
    alphabet = "aA bB.\n \t'sé日<|endoftext|>́ 1½Σ"
    some = ODD_TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)] + list(texts(spark).values())[:60]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    lib = library(path)
    encoded = bpe.encode_documents(df, path)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()}
    want = [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]
    assert [got[i] for i in range(len(some))] == want
    back = {r.doc_id: r.text for r in bpe.decode_documents(encoded, path).collect()}
    assert [back[i] for i in range(len(some))] == [lib.decode(w, skip_special_tokens=False) for w in want]


def test_op5_digests(spark):
    lib, own = library(WORD), texts(spark)
    for r in queries.op5_bpe_codec(spark, SF).collect():
        ids = lib.encode(own[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for a in (rng.integers(0, 50257, n), rng.zipf(1.3, n) % 2**32, np.full(n, 7), np.where(rng.random(n) < 0.02, 2**32 - 1, 3)):
        starts, data = tokenfile.pack_blocks(a.astype(np.uint32))
        assert (tokenfile.unpack_blocks(starts, data, n) == a).all()
        if n > 600:
            assert (tokenfile.unpack_blocks(starts, data, n, 1, 2) == a[256:512]).all()


def test_op7_files(spark):
    lib, at = library(BYTE), 0
    own = texts(spark)
    own |= {10_000 + i: t for i, t in enumerate(ODD_TEXTS)}
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in tokenfile.read(tokenfile.write(df, BYTE, 2)).collect()}
    for d in sorted(own):
        ids = [*lib.encode(own[d], add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# repeats


def brute_bytes(rows, least):
    first, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - least + 1):
            if raw[p : p + least] in first:
                gone[p : p + least] = b"\1" * least
            first.add(raw[p : p + least])
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[d] = (len(raw), sum(gone), sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("tuning", [{}, {"often": 1, "hot": 1, "part": 700, "piece_anchors": 40}, {"often": 1000, "hot": 2, "part": 2000}, {"often": 2, "part": 150, "piece_anchors": 1}])
def test_suffix_dedup(spark, tuning):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abc ") for _ in range(rng.randint(50, 300))) for _ in range(10)]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 40) :] for _ in range(rng.randint(0, 5)))) for i in range(120)]
    rows += [(300, None), (301, ""), (302, "a" * 3000), (303, "a" * 99), (304, "a" * 100), (305, "ab" * 300), (306, "é" * 200), (307, "x" + "ab" * 200)]
    got = suffixdedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **tuning).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(rows, 100)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_op6_on_documents(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_suffix_dedup(spark, SF).collect()}
    assert got == brute_bytes(list(texts(spark).items()), 100)


def test_line_dedup_small(spark):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    a, b, c, d = words(1, 60), words(2, 30), words(3, 25), words(4, 10)
    rows = [(1, f"{a}\n{b}\n{c}"), (2, f"x\n{a}\ny"), (3, f"{b}\n{c}\nz"), (4, f"{b}\nq\n{c}"), (5, f"{a}\n{d}\n{a}"), (6, d), (7, d)]
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    assert got == {1: rows[0][1], 2: "x\ny", 3: "z", 4: rows[3][1], 5: d, 6: d, 7: d}


# near duplicates


def jaccard(a, b):
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


@pytest.mark.parametrize("limits", [{}, {"small": 2, "block": 4, "hub_rounds": 1}])
def test_near_duplicates(spark, limits):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(3000)}" for _ in range(80)] for _ in range(6)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(200, "la " * 50), (201, "la " * 70), (202, "one two"), (203, "one  two"), (204, ""), (205, None), (206, " \n")]
    sets = {}
    for d, t in rows:
        w = (t or "").split()
        sets[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **limits).collect()
    want = unite(list(sets), links)
    assert {r.doc_id: r.class_id for r in got} == want and all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_similarity_is_exact():
    rng = random.Random(9)
    for _ in range(50):
        a, b = (Counter({rng.randrange(12): rng.randint(1, 4) for _ in range(rng.randint(1, 8))}) for _ in range(2))
        x, y = ((np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], np.uint32)) for c in (a, b))
        assert abs(neardup.similarity(x, y) - jaccard(a, b)) < 1e-9


def test_signature_estimates_similarity():
    a = [(np.arange(0, 300, dtype=np.uint64), np.ones(300)), (np.arange(60, 360, dtype=np.uint64), np.ones(300))]
    doc = np.repeat([0, 1], 300)
    own = neardup.signatures(doc, np.concatenate([x for x, _ in a]), np.concatenate([w for _, w in a]), 2, 2000)
    assert abs((own[0] == own[1]).mean() - 240 / 360) < 0.05


@pytest.mark.parametrize("block", [vectors.BLOCK, 20])
def test_vectors(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    rows = [(i, (centres[rng.integers(30)] + 0.12 * rng.standard_normal(16)).tolist()) for i in range(500)]
    rows += [(500 + i, rows[0][1]) for i in range(40)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None] + [1.0] * 15), (604, []), (605, [1.0, 0.0]), (606, [2.0, 0.0]), (607, [float("inf")] * 16)]
    got = {r.vec_id: r for r in vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), leaf=64, block=block).collect()}
    good = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for a, x in good for b, y in good if a < b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9]
    n = Counter(x for link in links for x in link)
    assert set(got) == {i for i, _ in rows} and all(got[i].n_links <= n[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n.values())  # recall
    want = unite([i for i, _ in rows], links)
    assert np.mean([got[i].component_id == want[i] for i in want]) > 0.95
    assert all(got[i].n_links == 0 and got[i].kept for i in (600, 601, 602, 603, 604, 607)) and got[606].component_id == 605


@pytest.mark.parametrize("limit", [10**6, 10])
def test_components(spark, limit):
    rng = random.Random(2)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(5), "t", limit).collect()}
    nodes = {x for a, b in edges for x in (a, b) if a != b}
    assert got == {k: v for k, v in unite({x for e in edges for x in e}, edges).items() if k in nodes}


# patterns

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("a@.+1 2-9()4é\n🎉%0") for _ in range(rng.randint(0, 120)))) for i in range(500)]
    rows += [(9000 + i, f"contact ssnid {10000 + i * 37}-{i} and x@y.com then ssnid a{i}@b.com, the year {2000 + i}") for i in range(40)]
    rows += [(10001, "1" * 50000), (10002, "a" * 50000), (10003, "1 " * 9000), (10004, None), (10006, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 4539 1488 0343 6467 4539-1488-0343-6467 256.1.1.1 +1 (389) 555-5010"), (10007, "+1 " * 3000), (10008, "a@" * 5000)]
    found = 0
    for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        text = dict(rows)[r.doc_id] or ""
        base = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PII.items()) for m in re.finditer(p, text) if personal(kind, m[0]))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[3] == k for b in base) for k in PII)
        context = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("context")]
        assert all(re.fullmatch(r"[0-9]+-[0-9]+", text[s:e]) for s, e in context)  # what follows ssnid, not the years
        found += len(context)
    assert found == 40


def test_secrets(spark):
    rng = random.Random(7)
    key = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(40))
    rows = [(1, f"bearer {key} ok"), (2, f"the {key} ok"), (3, "PassWord = 'abcdefgh1' ſecret=abcdefgh1"), (4, "token: short"), (5, "AKIA" + "A" * 12 + " AKIA" + "A" * 11), (6, "f" * 32 + " " + "f" * 31), (7, None), (8, "é" * 10 + 'api_key="x1234567"'), (9, "secret handler_for_request_42 handler_for_request_42 handler_for_request_42"), (10, "private key_" + "1" * 4000)]
    got = {r.doc_id: r for r in secrets.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == "novel:7:47" and got[2].spans == "" and got[9].spans == ""
    assert got[3].spans == "assign:0:21" and got[4].spans == "" and got[5].spans == "access:0:16" and got[6].spans == "hex:0:32" and got[7].spans == ""
    assert got[8].spans == "assign:10:27" and got[8].n_assign == 1 and got[10].n_hex >= 1


def test_contamination_blocks_and_cut(spark):
    b = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "Éa zz"), (3, None), (4, "..."), (5, "solo")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x A, b c d e f g h i j k y"), (2, "éa zz"), (3, "Éa. ZZ éa"), (4, None), (5, "a b c d e f g h i"), (6, "solo Solo, so")], "doc_id long, text string")
    for limit in (1 << 20, 1):  # one block, and one for each item
        got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in contamination.find(d, b, block_bytes=limit).collect()}
        assert got == {1: (13, 11, ["1"]), 2: (2, 0, []), 3: (3, 2, ["2"]), 4: (0, 0, []), 5: (9, 0, []), 6: (3, 2, ["5"])}
    kept = {r.doc_id: r.text for r in contamination.cut(d, b).collect()}
    assert kept == {1: "x  y", 2: "éa zz", 3: " éa", 4: "", 5: "a b c d e f g h i", 6: ", so"}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op3_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.97


# odd cases of every operator

RUN = {
    "linededup": lambda d, b, lab: linededup.dedup(d),
    "neardup": lambda d, b, lab: neardup.classes(d),
    "quality": lambda d, b, lab: quality.score(d, quality.fit(d, lab)),
    "pii": lambda d, b, lab: pii.digests(d),
    "bpe": lambda d, b, lab: bpe.digests(d, WORD),
    "suffixdedup": lambda d, b, lab: suffixdedup.remove(d),
    "tokenfile": lambda d, b, lab: tokenfile.read(tokenfile.write(d, BYTE, 2)),
    "secrets": lambda d, b, lab: secrets.digests(d),
    "contamination": lambda d, b, lab: contamination.digests(d, b),
}
CLASHES = ("score", "predicted", "node", "band", "h", "th", "p", "n", "k", "blob", "start", "part", "at", "row", "words", "lines", "gone", "text_h", "spans", "base", "component", "quality", "c")


@pytest.mark.parametrize("name", sorted(RUN))
def test_odd_rows(spark, name):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(None, "no id"), (None, None), (1, None), (2, ""), (3, "same row twice"), (3, "same row twice"), (3, "same id, other text"), (4, long), (5, "tie"), (6, "tie")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("x"))
    bench = spark.createDataFrame([(1, "w1 w2 w3"), (None, None)], "item_id long, text string").withColumn("words", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int").withColumn("h", F.lit(1))
    got = RUN[name](docs, bench, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    twice = [tuple(v for k, v in r.asDict().items() if k != "start") for r in got if r.doc_id == 3]
    assert max(Counter(map(str, twice)).values()) >= 2  # repeated rows get the same result
    empty = docs.where("false")
    assert RUN[name](empty, bench.where("false"), labels.where("false")).count() == 0
    assert RUN[name](docs, bench.where("false"), labels.where("false")).count() == len(rows)


def test_odd_vectors(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("links", F.lit(2))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near(df).collect()), key=str)
    assert got == sorted([(None, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)], key=str)
    assert vectors.near(df.where("false")).count() == 0
