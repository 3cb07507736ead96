"""The pipeline's stages against their operators, and the whole on planted rows."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from loggrove.llm import common, queries


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        docs = common.stored(out, "test")
        after = {r.doc_id: r for r in docs.collect()}
        assert after.keys() <= before.keys() and all(r.n_chars == len(r.text) for r in after.values())
        if name == "quality_classifier":
            assert after.keys() == {r.doc_id for r in queries.op3_quality_classifier(spark, sf).collect() if r.predicted}
        before = after
    # nothing of the benchmark is left
    from loggrove.llm import contamination

    assert contamination.find(docs, common.table(spark, sf, "benchmark")).where("n_hit > 0").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == len(before)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    line = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage = line(60)
    one = "\n".join(line(12) for _ in range(10))
    rows = [(1, one), (2, one), (3, f"{line(20)}\n{passage}"), (4, f"{passage}\n{line(20)}"), (5, None), (None, "no id here"), (6, "")]
    path = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    assert {1, 3, 4} <= got and 2 not in got


CLASHES = ("score", "predicted", "__scored", "__text", "__h", "n_lines", "n_removed", "spans", "items", "n_words", "n_hit", "row", "text_h", "gone", "kept", "class_id", "node", "ids", "n_tokens", "a.b")


def test_clashing_names_and_empty_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents").limit(40)
    docs = common.stored(docs, "test")
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema.fieldNames() == docs.schema.fieldNames()
            for r in out.collect():
                assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHES)
        else:
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() == docs.count()
        assert stage(spark, docs.where("false"), sf).count() == 0
    for t in ("documents", "labels", "benchmark"):
        common.table(spark, sf, t).where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_of_one_id(spark):
    """A row goes for its own text, not for that of another row with its id."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (3, text), (3, "some other text"), (None, text), (None, None)], "doc_id long, text string")
    got = corpus_pipeline.minhash_near_dedup(spark, docs, "").collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(1, text), (3, "some other text"), (None, None)], docs.schema).collect()))
