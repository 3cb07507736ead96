"""Brute force and both sides of former limits, for operators that SQL can't express."""

import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from loggrove.llm import base_sql, common, contamination, neardup, pii, quality, queries, secrets, tokenfile

SF = "/root/testdata/sf0.001"


def test_scores_are_those_of_plain_compression(spark):
    """op3 from the model alone: sizes by compressors that are made anew for each chunk."""
    docs = common.table(spark, SF, "documents")
    model = quality.fit(docs, common.table(spark, SF, "labels"))

    def size(data, known):
        own = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False).compress(data))

    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in docs.where("length(text) < 6000").limit(40).collect():
        raw = (r.text or "").encode()
        f = [0.0] * len(model.mean)
        if raw:
            cut = [raw[i : i + 1024] for i in range(0, len(raw), 1024)]
            good, bad = (sum(size(c, known) for c in cut) for known in (model.good, model.bad))
            own = np.log((len(zstandard.ZstdCompressor(level=quality.LEVEL, write_checksum=False, write_content_size=False).compress(raw)) + 1) / len(raw))
            f = [(good - bad) / len(raw), min(good, bad) / len(raw), own, own * own]
        z = sum((x - m) / s * w for x, m, s, w in zip(f, model.mean, model.scale, model.weights)) + model.weights[-1]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 0.02  # a prepared dictionary differs from a plain one by a byte now and then


@pytest.mark.parametrize("base", range(0, 0x110000, 0x44000))
def test_op7_on_all_code_points(base):
    """tiktoken gives the ids of the tokenizers library for each code point, between blanks, letters, digits and signs."""
    from tokenizers import Tokenizer

    path = queries.vocabulary_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    own = tokenfile.Fast(open(path, encoding="utf-8").read())
    points = [chr(c) for c in range(base, base + 0x44000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}{c} {c}a1{c}.{c}\n{c}" for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text).tolist() == want.ids


def test_blocks_of_a_benchmark_find_the_same(spark):
    docs, bench = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    rows = lambda df: sorted(map(str, df.collect()))
    whole = rows(contamination.find(docs, bench))
    assert rows(contamination.find(docs, bench, block_bytes=2000)) == whole
    assert rows(contamination.cut(docs, bench, block_bytes=2000)) == rows(contamination.cut(docs, bench))


def test_a_large_benchmark(spark):
    """32 MB of items in two blocks: no list of them all, and only windows whose words occur are searched."""
    words = F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(200_000)).cast("string")))
    bench = common.stored(spark.range(9500).select(F.col("id").alias("item_id"), F.array_join(words, " ").alias("text")), "test")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0]
    assert contamination.BLOCK_BYTES < size <= 3 * contamination.BLOCK_BYTES
    some = bench.where("item_id % 1000 = 7").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before it "), F.substring_index("text", " ", 60), F.lit(" after it")).alias("text"))
    docs = some.unionByName(spark.createDataFrame([(-1, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (-2, None)], some.schema))
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in contamination.find(docs, bench).collect()}
    assert got == {**{7 + 1000 * k: (64, 60, [str(7 + 1000 * k)]) for k in range(10)}, -1: (9, 0, []), -2: (0, 0, [])}


def test_near_duplicates_of_a_whole_table(spark):
    """op2 on sf0.01 against all pairs, by an inverted index."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").collect()
    texts = [r for r in docs if (r.text or "").split()]
    own = [neardup.shingles([r.text.encode()]) for r in texts]
    sets, weights = [o[1] for o in own], [o[2].astype(np.uint32) for o in own]
    n = len(texts)
    links = neardup.crossing(sets, weights, list(range(n)), np.zeros(n, np.int64), 0, 0, 0.8)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, r in enumerate(texts):
        least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    want = {r.doc_id: least[root(i)] for i, r in enumerate(texts)}
    got = {r.doc_id: r.class_id for r in queries.op2_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert {d: got[d] for d in want} == want and all(got[r.doc_id] == r.doc_id for r in docs if r.doc_id not in want)
    print("documents", len(docs), "classes", len(set(got.values())))


def test_very_long_texts_in_a_large_band(spark):
    """A group of near copies with texts of some megabytes: blocks are bounded by bytes."""
    rng = random.Random(4)
    long = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    rows = []
    for k in range(24):
        w = list(long if k < 6 else long[:400])
        for _ in range(len(w) // 60):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    got = {r.doc_id: r.class_id for r in neardup.classes(df, small=2, hub_rounds=0, block_bytes=1 << 20).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_base_sql_on_odd_texts(spark):
    import duckdb

    rng = random.Random(6)
    some = [(i, "".join(rng.choice("a@.+1 2-9()4é🎉%0") for _ in range(rng.randint(0, 120)))) for i in range(300)]
    some += [(1000 + i, "".join(rng.choice(["pass", "word", "TOKEN", "api_Key", "=", ": ", '"', "'", "AKIA", "AB12", "f00d", "0" * 30, " ", "x"]) for _ in range(12))) for i in range(300)]
    some += [(2000, None), (2001, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", some)
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    for run, kinds in ((pii.digests, base_sql.PII), (secrets.digests, base_sql.SECRETS)):
        got = sorted(tuple(r) for r in run(df).drop("spans").collect())
        assert got == sorted(con.execute(base_sql.oracle(kinds)).fetchall())
