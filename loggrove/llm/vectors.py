"""Near-duplicate embeddings by a forest of random-projection trees.

A tree splits vectors again and again by their projections on a random direction, one for each level; vectors near a split
spill to both sides. Splits are fitted on a bounded sample: at the quantile that separates most vectors for the pairs that it
tears apart, which is measured with linked pairs of the sample and with made ones at the cosine threshold. A node where every split would tear pairs nearly as fast as
it separates vectors (a group of near copies) isn't split. Below the nodes that the sample can tell apart, levels go on with
thresholds of the node's sample, so depth follows the number of vectors while what is broadcast follows the sample. Trees are
added until pairs of both kinds meet in one with probability RECALL. Where the leaves of all
trees would hold a share of ENOUGH of all pairs or more, every pair is compared instead, which is exact.

Vectors are compared with all others of a leaf, in double precision. A pair that meets in several leaves counts in the first
one only, which the trees tell from the two vectors alone; so a leaf returns sums and a spanning forest of its links, not its
pairs, and nothing has to be made distinct afterwards. A leaf beyond `block` vectors is compared in blocks, each pair of
blocks a task of its own. Equal vectors are one, with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COSINE = 0.9
#: Vectors of a leaf, about; share of a node's vectors on each side of a split that go both ways.
LEAF, SPILL = 384, 0.02
#: Probability with which a pair at the threshold is to meet; share of all pairs in leaves from which all pairs are compared.
RECALL, ENOUGH = 0.99, 0.25
#: Bound of the sample that the splits are fitted on: vectors, and bytes.
SAMPLE, SAMPLE_BYTES = 20_000, 48 << 20
#: Sampled vectors of a node from which it has a split of its own; quantiles that are tried; levels that a path may skip in all.
LEAST, QUANTILES, SKIPS = 128, (0.5, 0.35, 0.65, 0.2, 0.8), 8
#: A split must tear pairs slower than it separates vectors by this power.
WORTH = 0.7
#: Vectors of a leaf that are compared in one task.
BLOCK = 2048

ENDS, SPLITS, SKIPPED, GOES_ON = range(4)


class Pairs:
    """Pairs of unit vectors that should meet: x at the threshold from made partners, and linked ones of x."""

    def __init__(self, x: np.ndarray, cosine: float, seed: int, most: int = 4000):
        rng = np.random.default_rng(seed)
        some = x[rng.permutation(len(x))[:most]]
        made = rng.standard_normal(some.shape)
        made -= (made * some).sum(axis=1, keepdims=True) * some
        size = np.linalg.norm(made, axis=1, keepdims=True)
        made = cosine * some + np.sqrt(max(0.0, 1 - cosine * cosine)) * np.where(size > 0, made / np.where(size > 0, size, 1), 0)
        left, right = [some], [made]
        for s in range(0, len(some), 500):  # any one of those that are linked to a vector
            near = some[s : s + 500] @ x.T
            near = np.where((near >= cosine) & (near < 1 - 1e-12), rng.random(near.shape), -1.0)
            best = near.argmax(axis=1)
            live = near[np.arange(len(best)), best] >= 0
            left.append(some[s : s + 500][live]), right.append(x[best[live]])
        self.left, self.right = np.concatenate(left), np.concatenate(right)
        self.linked = np.arange(len(self.left)) >= len(some)

    def least(self, kept: np.ndarray, linked: np.ndarray) -> float:
        """The share of pairs that are kept, of the kind that is worse; a kind with few pairs says nothing."""
        return min((float(kept[own].mean()) for own in (linked, ~linked) if own.sum() >= 16), default=1.0)


class Tree:
    """Nodes are numbered as in a heap: node k has the children 2k and 2k + 1, the root is 1; a skipped level goes to 2k.

    A vector goes left if its projection on the level's direction is at most high, and right if it is at least low.
    """

    def __init__(self, x: np.ndarray, pairs_: Pairs, n: int, leaf: int, seed: int, spill: float = SPILL, least: int = LEAST):
        """x: sampled unit vectors out of n."""
        self.levels = max(0, int(np.ceil(np.log2(max(1.0, n / leaf))))) + SKIPS
        self.directions = np.random.default_rng(seed).standard_normal((self.levels, x.shape[1]))
        self.pairs = pairs_
        a, left, right = (v @ self.directions.T for v in (x, pairs_.left, pairs_.right))
        nodes: dict[int, tuple[int, float, float, int]] = {}
        tails: list[np.ndarray] = []
        ends: list[int] = []
        waiting = [(1, 0, np.arange(len(x)), np.arange(len(left)))]
        while waiting:
            node, level, own, pairs = waiting.pop()
            held = n * len(own) / max(1, len(x))  # vectors of the node, about
            if held <= leaf or level >= self.levels:
                nodes[node] = (ENDS, 0.0, 0.0, -1)
            elif len(own) < least:
                bounds = np.full((self.levels, 2), np.nan)
                while held > leaf and level < self.levels:
                    if found := self.split(a[own, level], left[pairs, level], right[pairs, level], pairs_.linked[pairs], spill, QUANTILES[:1]):
                        bounds[level] = found
                        held /= 2
                    level += 1
                nodes[node] = (GOES_ON, 0.0, 0.0, len(tails))
                tails.append(bounds)
                ends.append(level)
            elif found := self.split(a[own, level], left[pairs, level], right[pairs, level], pairs_.linked[pairs], spill, QUANTILES):
                low, high = found
                nodes[node] = (SPLITS, low, high, -1)
                middle = (low + high) / 2
                p, q, r = a[own, level], left[pairs, level], right[pairs, level]
                waiting.append((2 * node, level + 1, own[p <= middle], pairs[(q <= high) & (r <= high)]))
                waiting.append((2 * node + 1, level + 1, own[p > middle], pairs[(q >= low) & (r >= low)]))
            else:
                nodes[node] = (SKIPPED, 0.0, 0.0, -1)
                waiting.append((2 * node, level + 1, own, pairs))
        self.ids = np.array(sorted(nodes), np.int64)
        self.state = np.array([nodes[k][0] for k in self.ids.tolist()])
        self.low = np.array([nodes[k][1] for k in self.ids.tolist()])
        self.high = np.array([nodes[k][2] for k in self.ids.tolist()])
        self.tail = np.array([nodes[k][3] for k in self.ids.tolist()])
        self.tails = np.stack(tails) if tails else np.full((1, self.levels, 2), np.nan)
        self.ends = np.array(ends or [0])
        del self.pairs  # only for the fit

    def split(self, x: np.ndarray, p: np.ndarray, q: np.ndarray, linked: np.ndarray, spill: float, quantiles: tuple[float, ...]) -> tuple[float, float] | None:
        """The bounds (low, high) of the best split of projections x, where the pairs (p, q) should stay together; None if none is worth it."""
        best, out = WORTH, None
        for at in quantiles:
            low, high = np.quantile(x, (max(0.0, at - spill), min(1.0, at + spill)))
            share = (x <= high).mean() ** 2 + (x >= low).mean() ** 2
            kept = self.pairs.least(((p <= high) & (q <= high)) | ((p >= low) & (q >= low)), linked)
            if share < 0.9 and kept > 0 and np.log(kept) / np.log(share) < best:
                # never just at a vector's projection, whose last bits depend on how many are projected at once
                best, out = np.log(kept) / np.log(share), (float(low) - 1e-9, float(high) + 1e-9)
        return out

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves: a row for each leaf of each vector."""
        p = x @ self.directions.T
        row, node, tail = np.arange(len(x)), np.ones(len(x), np.int64), np.full(len(x), -1)
        out_row, out_node = [], []
        for level in range(self.levels + 1):
            at = np.minimum(np.searchsorted(self.ids, node), len(self.ids) - 1)
            state = np.where(tail >= 0, GOES_ON, self.state[at])
            tail = np.where((tail < 0) & (state == GOES_ON), self.tail[at], tail)
            over = np.where(tail >= 0, level >= self.ends[tail], state == ENDS) | (level == self.levels)
            out_row.append(row[over]), out_node.append(node[over])
            row, node, tail, state, at = (v[~over] for v in (row, node, tail, state, at))
            if not len(row):
                break
            low = np.where(tail >= 0, self.tails[tail, level, 0], self.low[at])
            high = np.where(tail >= 0, self.tails[tail, level, 1], self.high[at])
            skip = np.where(tail >= 0, np.isnan(low), state == SKIPPED)
            own = p[row, level]
            left, right = skip | (own <= high), ~skip & (own >= low)
            row, node, tail = np.r_[row[left], row[right]], np.r_[2 * node[left], 2 * node[right] + 1], np.r_[tail[left], tail[right]]
        return np.concatenate(out_row), np.concatenate(out_node)

    def share(self, x: np.ndarray) -> float:
        """Pairs of x that the leaves hold, counted once for each leaf, for each pair of x."""
        n = np.unique(self.leaves(x)[1], return_counts=True)[1].astype(float)
        return float((n * (n - 1)).sum() / max(1, len(x) * (len(x) - 1)))

    def together(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether row i of x shares a leaf with row i of y."""
        (r, j), (s, k) = self.leaves(x), self.leaves(y)
        out = np.zeros(len(x), dtype=bool)
        # rows and leaves as one number each
        leaf = np.unique(np.r_[j, k], return_inverse=True)[1]
        top = int(leaf.max()) + 1 if len(leaf) else 1
        out[np.intersect1d(r * top + leaf[: len(r)], s * top + leaf[len(r) :]) // top] = True
        return out


def grow(x: np.ndarray, n: int, leaf: int = LEAF, cosine: float = COSINE, recall: float = RECALL, enough: float = ENOUGH, spill: float = SPILL, seed: int = 7) -> list[Tree] | None:
    """Trees for n vectors, fitted on sampled unit vectors x; None where comparing all pairs is better."""
    pairs, others = Pairs(x, cosine, seed), Pairs(x, cosine, seed + 1)  # for the fit, and to measure it
    met, total, out = np.zeros(len(others.left), dtype=bool), 0.0, []
    while others.least(met, others.linked) < recall:
        out.append(Tree(x, pairs, n, leaf, seed * 1000 + len(out), spill))
        total += out[-1].share(x)
        if total >= enough:
            return None
        met |= out[-1].together(others.left, others.right)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def first_met(a: np.ndarray, b: np.ndarray, x: np.ndarray, forest: list[Tree], tree: int, leaf: int) -> np.ndarray:
    """Whether this leaf of this tree is the first that rows a[i] and b[i] of x share: no earlier tree, no smaller leaf of this one."""
    first = np.ones(len(a), dtype=bool)
    rows, of = np.unique(np.r_[a, b], return_inverse=True)
    for t in range(tree + 1):
        left, right = np.flatnonzero(first), None
        if not len(left):
            break
        r, node = forest[t].leaves(x[rows])
        if t == tree:
            r, node = r[node < leaf], node[node < leaf]
        order = np.argsort(r, kind="stable")
        r, node = r[order], node[order]
        n = np.bincount(r, minlength=len(rows))
        wide = int(n.max()) if len(n) else 0
        path = np.full((len(rows), wide), -1, np.int64)
        path[r, np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)] = node
        met = np.zeros(len(left), dtype=bool)
        i, j = of[: len(a)][left], of[len(a) :][left]
        for c in range(wide):
            for d in range(wide):
                right = path[i, c]
                met |= (right == path[j, d]) & (right >= 0)
        first[left[met]] = False
    return first


def compare(x: np.ndarray, weight: np.ndarray, side: np.ndarray, cosine: float, first: int, second: int, counts=None) -> tuple[np.ndarray, np.ndarray]:
    """Of the vectors of a leaf, or of two of its blocks: weights linked to each, and a smaller linked row of each.

    counts: which of the pairs (a, b) count here; all of them if it is None.
    """
    n = len(x)
    links, root = np.zeros(n, np.int64), np.arange(n)
    rows = np.flatnonzero(side == first)
    others = rows if first == second else np.flatnonzero(side == second)
    for s in range(0, len(rows), 512):
        own = rows[s : s + 512]
        a, b = np.nonzero(x[own] @ x[others].T >= cosine)
        a, b = own[a], others[b]
        if first == second:
            keep = a < b
            a, b = a[keep], b[keep]
        if counts is not None and len(a):
            keep = counts(a, b)
            a, b = a[keep], b[keep]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        ends = np.flatnonzero(np.r_[a[1:] != a[:-1], True]) + 1 if len(a) else []
        at = 0
        for e in ends:  # a row's links at once
            met = np.unique(root[np.r_[a[at], b[at:e]]])
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
            at = e
    return links, root


def near(vectors: DataFrame, cosine: float = COSINE, leaf: int = LEAF, spill: float = SPILL, recall: float = RECALL, enough: float = ENOUGH, sample: int = SAMPLE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, zero, empty or hold null or non-finite components link with nothing; vectors of different lengths
    don't link. Equal rows link with each other (each row is a vector of its own, whatever its id). component_id is the
    smallest id of the component; kept says that it is the row's own. Extra columns aren't read; an empty table gives an
    empty one. A length with block vectors or fewer has one leaf, so the driver sees fewer than n / block lengths.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, data, size = [], [], []
            for v in batch.column(1):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid and len(v.values) else np.zeros(0)
                if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
                    raw = np.ascontiguousarray(x + 0.0, "<f8").tobytes()  # -0.0 becomes 0.0
                    node.append(xxhash.xxh3_128_digest(raw))
                    data.append(np.ascontiguousarray(x, "<f4").tobytes() if (x.astype(np.float32) == x).all() else raw)
                    size.append(len(x))
                else:
                    node.append(None), data.append(None), size.append(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.binary()), pa.array(data, pa.binary()), pa.array(size, pa.int32())], names=["vec_id", "node", "data", "size"])

    cleaned = common.stored(rows.mapInArrow(clean, "vec_id long, node binary, data binary, size int"), "vectors")
    nodes = common.stored(cleaned.where("node is not null").groupBy("node").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"), F.any_value("data").alias("data"), F.any_value("size").alias("size")), "vector-nodes")
    forests = {}
    for size, n in [(r.size, r.n) for r in nodes.groupBy("size").agg(F.count("*").alias("n")).where(F.col("n") > max(leaf, min(block, 4 * leaf))).collect()]:
        most = max(64, min(sample, SAMPLE_BYTES // (8 * size)))
        got = nodes.where(F.col("size") == size).orderBy(F.xxhash64("node"), "node").limit(most).select("data").collect()
        forest = grow(_unit(np.stack([decode(bytes(r.data), size) for r in got])), n, leaf, cosine, recall, enough, spill, seed)
        if forest:
            forests[size] = forest
    held = spark.sparkContext.broadcast(forests)  # a tree: a direction for each level, and thresholds for nodes of the sample

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = held.value
        for batch in batches:
            size = np.array(batch.column(3).to_pylist())
            data = batch.column(1).to_pylist()
            for s in np.unique(size).tolist():
                own = np.flatnonzero(size == s)
                x = _unit(np.stack([decode(data[i], s) for i in own.tolist()])) if s in forests else None
                for t, tree in enumerate(forests.get(s, [None])):
                    row, node = tree.leaves(x) if tree else (np.arange(len(own)), np.zeros(len(own), np.int64))
                    take = pa.array(own[row])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), s), pa.int32()), pa.array(np.full(len(row), t), pa.int32()), pa.array(node, pa.int64()), batch.column(0).take(take), batch.column(2).take(take), batch.column(1).take(take)], names=["size", "tree", "leaf", "node", "w", "data"])

    routed = nodes.select("node", "data", "w", "size").mapInArrow(route, "size int, tree int, leaf long, node binary, w long, data binary")
    routed = common.stored(routed, "vector-leaves")
    # leaves beyond a block, with their number of blocks: fewer than routed rows / block
    counts = common.stored(routed.groupBy("size", "tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > block), "vector-blocks")
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    routed = routed.join(counts, ["size", "tree", "leaf"], "left").withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = routed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("n", "other", "blocks")

    def within(key, table):
        size, tree, leaf, i, j = (k.as_py() for k in key)
        node = table.column("node").to_pylist()
        x = _unit(np.stack([decode(d, size) for d in table.column("data").to_pylist()]))
        forest = held.value.get(size)
        counts = (lambda a, b: first_met(a, b, x, forest, tree, leaf)) if forest else None
        links, root = compare(x, np.array(table.column("w").to_pylist()), np.array(table.column("side").to_pylist()), cosine, i, j, counts)
        live = np.flatnonzero(links > 0)
        return pa.table({"node": pa.array([node[k] for k in live], pa.binary()), "links": pa.array(links[live], pa.int64()), "root": pa.array([node[root[k]] for k in live], pa.binary())})

    dealt = dealt.repartition(common.parts(spark), "size", "tree", "leaf", "i", "j")  # small in bytes, but not in work
    found = common.stored(dealt.groupBy("size", "tree", "leaf", "i", "j").applyInArrow(within, "node binary, links long, root binary"), "vector-links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    united = common.components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors")
    placed = nodes.select("node", "w", "least").join(linked, "node", "left").join(united, "node", "left").select("node", "w", "least", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    placed = common.stored(placed, "vector-components")
    smallest = common.stored(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "vector-least")
    own = common.stored(common.join_spread(placed, smallest, "component").select("node", "n_links", "component_id", F.col("w").alias("n")), "vector-own")
    # rows that link with nothing need no join, and would all meet at one key
    out = common.join_spread(cleaned.where("node is not null").select("vec_id", "node"), own, "node").select("vec_id", "n_links", "component_id")
    out = out.unionByName(cleaned.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def decode(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if len(data) == 4 * size else "<f8").astype(np.float64)


#: DuckDB SQL for the result of near over embeddings.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM {embeddings}),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {cosine}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low ON v.vec_id = low.x LEFT JOIN n ON v.vec_id = n.x
"""


def oracle(embeddings: str = "embeddings", cosine: float = COSINE) -> str:
    return SQL.format(embeddings=embeddings, cosine=cosine)
