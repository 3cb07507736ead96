"""The share of good labels counts alike whether or not the sample is cut."""

import random

import numpy as np

from loggrove.llm import quality


def test_the_prior_does_not_move_with_the_bound(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(60)), int(i % 6 > 0)) for i in range(900)]  # nothing tells the classes apart
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(2).cache()
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    for bound in (4000, 100):
        got = [r.score for r in quality.score(docs, quality.fit(docs, labels, sample_rows=bound)).collect()]
        assert 0.75 < np.mean(got) < 0.92


def test_weights_count_as_repeated_rows():
    rng = np.random.default_rng(13)
    x = rng.standard_normal((60, 4))
    x = np.r_[x, -x]
    y = (x[:, 0] + rng.standard_normal(120) > 0).astype(float)
    twice = quality.calibrate(np.r_[x, x], np.r_[y, y])
    assert np.allclose(quality.calibrate(x, y, np.full(120, 2.0))[2], twice[2])
    assert quality.calibrate(x, y) == quality.calibrate(x, y, np.ones(120))
