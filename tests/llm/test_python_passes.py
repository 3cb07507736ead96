"""One Python pass for each table that the pipeline writes, and the cut by the worker that has found the hits."""

import corpus_pipeline
import pytest
from pyspark.sql import Row

from loggrove.llm import common, contamination


def passes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_one_python_pass(spark, monkeypatch):
    """Two in a row make two workers for each core, and an executor keeps both for the rest of the application."""
    sf, seen, write = "/root/testdata/sf0.001", {}, common.stored

    def stored(df, name):
        seen[name] = passes(df)
        return write(df, name)

    monkeypatch.setattr(common, "stored", stored)
    corpus_pipeline.run(spark, sf)
    assert {name for name, _ in corpus_pipeline.STAGES} <= seen.keys()
    assert {name: n for name, n in seen.items() if n > 1} == {}


@pytest.mark.parametrize("limit", [1 << 20, 30])
@pytest.mark.parametrize("row", [False, True])
def test_cut_is_text_less_spans(spark, limit, row):
    passage = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, passage), (2, "Žluťoučký kůň"), (3, "日本"), (4, None)], "item_id long, text string")
    texts = [passage, f"é {passage}, {passage} 𝄞", f"{passage[:-4]}", "日本 x 日本\n žluťoučký KŮŇ Žluťoučký kůň!", "", None, "😀日本😀 日本", f"a {passage} eleven\r\n{passage.upper()}"]
    docs = spark.createDataFrame([(i % 6, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    want = []
    for r in contamination.find(docs, bench, block_bytes=limit, row=True).collect():
        edges = [0, *(x for s in r.spans for x in (s.start, s.end)), len(r.text)]
        cut = "".join(r.text[a:b] for a, b in zip(edges[::2], edges[1::2]))
        want.append(Row(r.doc_id, cut, r.row) if row else Row(r.doc_id, cut))
    out = contamination.cut(docs, bench, block_bytes=limit, row=row)
    assert out.columns == ["doc_id", "text"] + ["row"] * row and passes(out) == 1
    got = [Row(*r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {cut[1] for cut in want} - set(texts) and len(want) == len(texts)


def test_lean_returns_freed_memory():
    """What a worker has freed goes back to the system at the end of its work, and the rows come as they are."""
    keep = []

    def work(batches):
        blocks = [bytes(100_000) for _ in range(1000)]
        keep.extend(bytearray(90_000) for _ in range(3))  # above the freed ones: the heap can't shrink from its end
        del blocks
        yield from batches

    before = resident()
    for _ in work([]):
        pass
    freed = resident()
    assert list(common.lean(work)(iter([1, 2, 3]))) == [1, 2, 3]
    assert freed - before > 50 and resident() - before < 25


def resident():
    """MB of this process."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6
