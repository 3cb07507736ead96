"""Line dedup in texts of very many lines, and with very frequent lines."""

import time

import numpy as np

from loggrove.llm import common, linededup


def test_a_million_blank_lines(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(k, "\n" * (200_000 + k) + passage) for k in range(2)] + [(5, passage), (6, "\n" * 3 + passage + "\n" * 3 + passage)]
    began = time.monotonic()
    alone = spark.createDataFrame([(1, "\n" * 10**6 + passage)], "doc_id long, text string")
    assert linededup.dedup(alone).first().n_removed == 0
    assert time.monotonic() - began < 30
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (200_001, 0, rows[0][1])
    # in the second text all but its first line repeats the first text's run of blank lines and passage
    assert got[1] == (200_002, 200_001, "")
    assert got[5] == (1, 1, "") and got[6][2] == ""


def test_minima_are_those_of_each_window():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        words = rng.integers(0, 4, n)
        hashes = [bytes([x]) for x in rng.integers(0, 6, n)]
        ahead, behind = linededup.spans(words, 5)
        starts = [i for i in range(n) if words[i:].sum() >= 5]
        assert ahead.tolist() == [next(j for j in range(i + 1, n + 1) if words[i:j].sum() >= 5) for i in starts]
        assert behind.tolist() == [max((i for i in range(j + 1) if words[i : j + 1].sum() >= 5), default=-1) for j in range(n)]
        want = [min((k for k in range(i, e) if words[k]), key=lambda k: (hashes[k], -k)) for i, e in zip(starts, ahead.tolist())]
        assert linededup.minima(hashes, words.tolist(), ahead.tolist()) == want


def test_frequent_keys_are_spread(spark):
    rows = common.stored(spark.range(6000).selectExpr("if(id < 3000, 0, id) as h", "id as x"), "t")
    unique = common.stored(rows.groupBy("h").count().withColumnRenamed("count", "n").where("h < 4000"), "t")
    got = common.join_spread(rows, unique, "h")
    assert sorted(r.x for r in got.collect()) == list(range(4000))
    assert common.join_spread(rows, unique, "h", how="left").count() == 6000
