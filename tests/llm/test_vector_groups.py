"""A large group of distinct near copies keeps its links."""

import numpy as np

from loggrove.llm import vectors


def group(rng, n, size=64, similar=0.92):
    """n distinct vectors, a third of them in one group whose pairs are at cosine `similar`, about."""
    x = rng.standard_normal((n, size))
    own = n // 3
    x[:own] = np.sqrt(similar) * x[-1] + np.sqrt(1 - similar) * x[:own]
    return x, own


def test_links_of_a_large_group(spark):
    x, own = group(np.random.default_rng(5), 3000)
    got = {r.vec_id: r for r in vectors.near(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), leaf=12).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= vectors.COSINE).sum(axis=1) - 1
    assert links[:own].sum() > own * own / 2
    assert [got[i].n_links for i in range(len(x))] == links.tolist()


def test_a_forest_keeps_the_pairs_of_groups_together():
    """Beyond the size at which all pairs are compared: groups at the threshold, of many sizes, in trees of depth 10."""
    rng = np.random.default_rng(6)
    x, own = group(rng, 12000)
    for s in range(own, 8000, 100):  # small groups too
        x[s : s + 100] = np.sqrt(0.92) * x[s] + np.sqrt(0.08) * rng.standard_normal((100, 64))
    x = vectors._unit(x)
    a = rng.integers(0, 8000, 20000)
    b = np.where(a < own, rng.integers(0, own, 20000), np.minimum(own + (a - own) // 100 * 100 + rng.integers(0, 100, 20000), 7999))
    linked = (a != b) & ((x[a] * x[b]).sum(axis=1) >= vectors.COSINE)
    a, b = a[linked], b[linked]
    assert len(a) > 5000
    # as for 400000 vectors, of which these are the sample
    forest = vectors.grow(x, 400_000, enough=10)
    met = np.zeros(len(a), dtype=bool)
    for t in forest:
        met |= t.together(x[a], x[b])
    print('trees', len(forest), 'recall', met.mean(), met[a < own].mean(), met[a >= own].mean())
    assert met.mean() > 0.99


def test_what_is_broadcast_follows_the_sample():
    """Depth and trees follow the number of vectors, nodes with thresholds of their own follow the sample."""
    x = vectors._unit(np.random.default_rng(8).standard_normal((4000, 32)))
    few, many = (vectors.grow(x, n) for n in (200_000, 50_000_000))
    assert many[0].levels == few[0].levels + 7 and len(many) < 4 * len(few)
    assert all(len(t.ids) < 4 * len(x) / vectors.LEAST for t in [*few, *many])
    assert sum(len(t.leaves(x)[0]) for t in many) / len(x) < 120  # copies of a vector
    sizes = np.unique(many[0].leaves(x)[1], return_counts=True)[1]
    assert sizes.mean() < 3  # leaves go on below the nodes of the sample


def test_rows_meet_first_in_one_leaf():
    rng = np.random.default_rng(9)
    x = vectors._unit(rng.standard_normal((600, 8)))
    pairs = vectors.Pairs(x, 0.9, 1)
    trees = [vectors.Tree(x, pairs, 600, 40, s, spill=0.1, least=20) for s in range(3)]
    a, b = np.triu_indices(600, 1)
    first = np.zeros(len(a), int)
    for t, tree in enumerate(trees):
        row, node = tree.leaves(x)
        for leaf in np.unique(node):
            own = np.zeros(600, dtype=bool)
            own[row[node == leaf]] = True
            k = np.flatnonzero(own[a] & own[b])
            first[k] += vectors.first_met(a[k], b[k], x, trees, t, int(leaf))
    met = np.zeros(len(a), dtype=bool)
    for tree in trees:
        leaves = [set() for _ in range(600)]
        for r, k in zip(*(v.tolist() for v in tree.leaves(x))):
            leaves[r].add(k)
        met |= np.array([not leaves[i].isdisjoint(leaves[j]) for i, j in zip(a.tolist(), b.tolist())])
    assert (first == met).all() and met.any() and not met.all()


def test_recall_of_a_forest(spark):
    """A table that is large enough for trees, against all pairs."""
    rng = np.random.default_rng(10)
    x = rng.standard_normal((12_000, 24))
    x[4000:] = x[:4000].repeat(2, axis=0) + rng.uniform(0, 0.45, (8000, 1)) * rng.standard_normal((8000, 24))
    got = {r.vec_id: r for r in vectors.near(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4), leaf=64, enough=1.0, block=256).collect()}
    assert vectors.grow(vectors._unit(x), len(x), 64, enough=1.0)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= vectors.COSINE).sum(axis=1) - 1
    have = np.array([got[i].n_links for i in range(len(x))])
    print(have.sum(), want.sum(), (have > want).sum())
    assert (have <= want).all() and have.sum() >= 0.985 * want.sum()
