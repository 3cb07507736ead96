"""Lines of both classes stay out of the classifier's dictionaries."""

from loggrove.llm import quality


def test_shared_lines_stay_out(spark):
    shared = "A passage that documents of both classes quote word for word."
    rows = [(i, f"{shared}\nown {'good' if i % 2 else 'bad'} line number {i}", i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert shared.encode() not in model.good + model.bad
    assert b"own good line" in model.good and b"own bad line" in model.bad
    assert b"own bad line" not in model.good and b"own good line" not in model.bad
