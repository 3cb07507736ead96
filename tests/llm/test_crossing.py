"""Links between components in two blocks of a large band."""

import random

import numpy as np
from test_operators import unite

from loggrove.llm import neardup


def sets_of(*texts):
    return [np.array(sorted(t), np.uint64) for t in texts]


def test_a_row_that_joins_the_largest_component_on_the_way():
    a, x = range(0, 20), range(100, 120)
    z, y = [*range(0, 19), 50], [*range(100, 119), 150]
    sets = sets_of(a, range(200, 220), range(300, 320), x, z, y)
    component = [b"A", b"A", b"A", b"B", b"B", b"C"]
    got = neardup.crossing(sets, [np.ones(len(s), np.uint32) for s in sets], component, np.array([0, 0, 1, 0, 1, 1]), 0, 1, 0.8)
    assert {tuple(sorted(p)) for p in got} == {(0, 4), (3, 5)}


def test_crossing_unites_as_all_pairs_do():
    rng = random.Random(8)
    for _ in range(200):
        bases = [rng.sample(range(1000), 20) for _ in range(5)]
        sets = sets_of(*({*rng.choice(bases)[rng.randint(0, 2) :], 2000 + i} for i in range(24)))
        component = [rng.choice("AAABCDEF") for _ in sets]
        side = np.array([rng.randrange(2) for _ in sets])
        links = [(i, j) for i in range(24) for j in range(24) if side[i] == 0 and side[j] == 1 and component[i] != component[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        got = neardup.crossing(sets, [np.ones(len(s), np.uint32) for s in sets], component, side, 0, 1, 0.8)
        nodes, same = [*range(24), *"ABCDEF"], list(enumerate(component))
        number = {k: i for i, k in enumerate(nodes)}
        edges = lambda links: [(number[a], number[b]) for a, b in [*links, *same]]
        assert unite(list(range(len(nodes))), edges(got)) == unite(list(range(len(nodes))), edges(links))
