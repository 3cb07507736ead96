"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A document is the multiset of its shingles of five words (white space separates words; a shorter text is one shingle).
Each shingle sends Poisson arrivals at a rate of its weight to random registers of the document's signature; a register keeps
its earliest arrival's shingle, and a shingle stops as soon as its next arrival is later than every register's. Two documents
agree in a register with the probability Jaccard similarity of their shingles. Signatures are cut into bands; documents that
agree in a band are candidates; candidates are verified by their exact similarity; links are united.

Documents with equal multisets are one node from the start (a group of copies costs one row). In a band, each node is first
paired with one hub only. Where nodes of a band are then still in different components, a second hub follows, and finally
every pair of such nodes: in a small band as rows, in a large one in blocks, by an inverted index of the shingles of a block,
which return the links between components alone. So no candidate link between components is left out, yet a group of
thousands of near copies makes some rows for each member, not for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .contamination import words

SHINGLE, SIMILARITY = 5, 0.8
#: 20 bands of 4 registers: a pair of similarity 0.8 is missed with probability 3e-5.
BANDS, BAND = 20, 4
HUB_ROUNDS = 2
#: Members up to which the rest of a band is compared as pairs; members, and bytes of shingles, of a block of a larger one, about.
SMALL, BLOCK, BLOCK_BYTES = 16, 2048, 32 << 20
SAME = np.arange(256, dtype=np.uint8)
BLACK = ~np.isin(SAME, [9, 10, 11, 12, 13, 32])
STEP = 0x9E3779B97F4A7C15
LOW48 = np.uint64((1 << 48) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, 48-bit hash and weight of each distinct shingle, by text and hash."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, _, h = words(raw, SAME, BLACK)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    n = np.bincount(doc, minlength=len(texts))
    last = np.cumsum(n)[doc] - 1  # of the document
    at = np.arange(len(h))
    whole = (at + size - 1 <= last) | (at == last - n[doc] + 1)
    key = np.zeros(len(h), np.uint64)
    for j in range(size):
        inside = at + j <= last
        key[inside] = mix(key[inside] ^ (h[at[inside] + j] + np.uint64(j + 1)))
    key = (doc.astype(np.uint64)[whole] << np.uint64(48)) | (key[whole] & LOW48)
    key.sort()
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.r_[head, len(key)])
    return (key[head] >> np.uint64(48)).astype(np.int64), key[head] & LOW48, weight


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """ProbMinHash signatures (n_docs, size): the hash of the shingle with the earliest arrival in each register; 0 where a document has none."""
    best = np.full((n_docs, size), np.inf)
    owner = np.zeros((n_docs, size), np.uint64)
    flat, own = best.ravel(), owner.ravel()
    x = np.zeros(len(h))
    k = 0
    seed = mix(h + np.uint64(1))
    while len(h):
        r = mix(seed + np.uint64(STEP * (2 * k + 1) % 2**64))
        x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight
        live = x < best.max(axis=1)[doc]
        if not live.all():
            doc, h, weight, x, seed = doc[live], h[live], weight[live], x[live], seed[live]
            if not len(h):
                break
        at = doc * size + (mix(seed + np.uint64(STEP * (2 * k + 2) % 2**64)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(flat, at, x)
        won = flat[at] == x
        own[at[won]] = h[won]
        k += 1
    return owner


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets (hashes, sorted, and weights): the sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    total = len(a[0]) + len(b[0]) - len(both)
    if a[1].max() == 1 and b[1].max() == 1:
        return len(both) / total
    wa, wb = np.r_[a[1][i], np.delete(a[1], i), np.zeros(len(b[0]) - len(both))].astype(float), np.r_[b[1][j], np.zeros(len(a[0]) - len(both)), np.delete(b[1], j)].astype(float)
    with np.errstate(divide="ignore"):
        ratio = wa / wb
    order = np.argsort(ratio, kind="stable")
    ratio = ratio[order]
    above = np.r_[np.cumsum(wa[order][::-1])[::-1], 0]
    below = np.r_[0, np.cumsum(wb[order])]
    n = len(both)
    at = np.searchsorted(ratio, wa[:n] / wb[:n])
    return float((1 / (above[at] / wa[:n] + below[at] / wb[:n])).sum())


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for piece in common.pieces(batch, limit=2 * common.PIECE_BYTES):
        for s in range(0, piece.num_rows, 1 << 15):  # the row's number has 16 bits beside the hash
            yield piece.slice(s, 1 << 15)


def _identities(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> list[bytes | None]:
    ends = np.searchsorted(doc, np.arange(n), side="right").tolist()
    out, at = [], 0
    for e in ends:
        out.append(xxhash.xxh3_128_digest(h[at:e].tobytes() + weight[at:e].tobytes()) if e > at else None)
        at = e
    return out


def classes(docs: DataFrame, similar: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, band: int = BAND, hub_rounds: int = HUB_ROUNDS, small: int = SMALL, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """(doc_id, class_id, kept[, text_h]) of each row: class_id is the smallest doc_id that is reachable by links of `similar` or more.

    Texts without words (null, empty, white space) link with nothing: each is its own class. Rows of one id count as the
    documents that they are, by text; a class whose rows have no id has none. kept: the row has the class's id. Rows that
    repeat id and text are all kept or all not. text_hash: with the xxhash64 of the row's text (a null one counts as empty).
    An empty table gives an empty one.
    """
    texts = common.as_texts(docs, id_col, text_col)

    @common.lean
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _groups(batch):
                doc, h, weight = shingles([t.encode() for t in piece.column(1).to_pylist()], size)
                n = piece.num_rows
                own = signatures(doc, h, weight, n, bands * band).reshape(n, bands, band)
                code = np.zeros((n, bands), np.uint64)
                for j in range(band):
                    code = mix(code ^ (own[:, :, j] + np.uint64(j + 1)))
                code = mix(code + np.arange(bands, dtype=np.uint64))
                node = _identities(doc, h, weight, n)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(node, pa.binary()), pa.array([c if k else None for c, k in zip(code.view(np.int64).tolist(), node)], pa.list_(pa.int64()))], names=["doc_id", "text_h", "node", "bands"])

    signed = common.stored(texts.select("doc_id", "text", F.xxhash64("text").alias("text_h")).mapInArrow(sign, "doc_id long, text_h long, node binary, bands array<long>"), "neardup-signed")
    first = F.min(F.struct("doc_id", "text_h"))
    nodes = common.stored(signed.where("node is not null").groupBy("node").agg(first.alias("at"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.any_value("bands").alias("bands")), "neardup-nodes")
    members = common.stored(nodes.select("node", F.explode("bands").alias("band")), "neardup-bands")
    shared = common.stored(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "neardup-shared")
    top = shared.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    limit = common.frequent_limit(top["all"])
    hot = (top["most"] or 0) > limit  # without a hot band no hub stands in many pairs either

    def at_bands(rows: DataFrame, unique: DataFrame) -> DataFrame:
        return common.join_spread(rows, unique, "band", limit=limit) if hot else rows.join(unique, "band")

    members = common.stored(at_bands(members, shared).select("band", "n", "node"), "neardup-members")

    @common.lean
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _groups(batch):
                doc, h, weight = shingles([t.encode() for t in piece.column(1).to_pylist()], size)
                found = _identities(doc, h, weight, piece.num_rows)
                ends = np.searchsorted(doc, np.arange(piece.num_rows), side="right").tolist()
                node, hs, ws, at = [], [], [], 0
                for want, own, e in zip(piece.column(2).to_pylist(), found, ends):
                    if want == own:
                        node.append(own)
                        hs.append(h[at:e].astype("<u8").tobytes())
                        ws.append(weight[at:e].astype("<u4").tobytes() if weight[at:e].max() > 1 else b"")
                    at = e
                yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.binary()), "h": pa.array(hs, pa.binary()), "w": pa.array(ws, pa.binary())})

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("at.doc_id").alias("own"), F.col("at.text_h").alias("own_h"))
    same = texts.withColumn("text_h", F.xxhash64("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("text_h") == F.col("own_h"))).select("doc_id", "text", "node")
    weighed = common.stored(same.mapInArrow(weigh, "node binary, h binary, w binary").dropDuplicates(["node"]), "neardup-shingles")

    @common.lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for h1, w1, h2, w2 in zip(*(batch.column(i) for i in range(2, 6))):
                x, y = (np.frombuffer(h.as_py(), "<u8") for h in (h1, h2))
                u, v = (np.frombuffer(w.as_py(), "<u4") if len(w.as_py()) else np.ones(len(s), np.uint32) for w, s in ((w1, x), (w2, y)))
                linked.append(similarity((x, u), (y, v)) >= similar)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    def verified(pairs: DataFrame, name: str, hot: bool) -> DataFrame:
        """A hub stands in as many pairs as its band has members: its pairs are split, and its shingles repeated for each part."""
        shingles_of = {x: weighed.select(F.col("node").alias(x), F.col("h").alias(f"h{x}"), F.col("w").alias(f"w{x}")) for x in "ab"}
        if hot:
            pairs = common.stored(pairs, f"{name}-pairs")
            counts = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
            frequent = common.stored(counts.where(F.col("n") > limit), f"{name}-frequent")  # hubs, fewer than FREQUENT_KEYS for each band of a signature
            right = common.join_salted(pairs, shingles_of["b"], "b", "a", frequent.withColumnRenamed("node", "b"), limit)
            full = common.join_salted(right, shingles_of["a"], "a", "b", frequent.withColumnRenamed("node", "a"), limit)
        else:
            full = pairs.join(shingles_of["b"], "b").join(shingles_of["a"], "a")
        return common.stored(full.select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(verify, "a binary, b binary, linked boolean"), name)

    done, more = None, None
    for k in range(hub_rounds + 1):
        if done is None:
            labels = members.select("band", "node", F.col("node").alias("component"))
        else:
            united = components_of(done, f"neardup-{k}")
            labels = common.stored(members.where("n > 2").join(united, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), f"neardup-labels-{k}")
        # bands whose nodes are in different components, each with its hub: its first node by an order that changes from round to round
        rank = F.struct(F.xxhash64(F.lit(k), "node"), F.col("node"), F.col("component"))
        several = labels.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"), F.min(rank).alias("hub")).where("x <> y")
        several = common.stored(several.select("band", "n", F.col("hub.node").alias("hub"), F.col("hub.component").alias("hub_component")), f"neardup-several-{k}")
        if k and several.isEmpty():
            break
        open_ = at_bands(labels, several)
        if k < hub_rounds:
            pairs = open_.where("component <> hub_component").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        else:
            open_ = common.stored(open_.select("band", "n", "node", "component"), "neardup-open")
            more = in_blocks(open_.where(F.col("n") > small), weighed, similar, block, block_bytes)
            few = open_.where(F.col("n") <= small)
            if few.isEmpty():
                break
            other = few.select("band", F.col("node").alias("b"), F.col("component").alias("c"))
            pairs = few.join(other, "band").where("component < c").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
        pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        new = verified(pairs, f"neardup-verified-{k}", hot and k < hub_rounds)  # the last pairs are those of small bands
        done = new if done is None else done.unionByName(new)
    if more is not None:
        done = more if done is None else done.unionByName(more)
    united = components_of(done, "neardup-end")
    placed = common.stored(nodes.select("node", "least", F.col("n").alias("rows")).join(united, "node", "left").withColumn("component", F.coalesce("component", "node")), "neardup-placed")
    smallest = common.stored(placed.groupBy("component").agg(F.min("least").alias("class_id"), F.count("*").alias("n")), "neardup-classes")
    own = common.stored(common.join_spread(placed, smallest, "component").select("node", "class_id", F.col("rows").alias("n")), "neardup-own")
    # rows without words need no join, and would all meet at one key
    full = common.join_spread(signed.where("node is not null").select("doc_id", "text_h", "node"), own, "node").select("doc_id", "text_h", "class_id")
    out = full.unionByName(signed.where("node is null").select("doc_id", "text_h", F.col("doc_id").alias("class_id")))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), *(["text_h"] if text_hash else []))


def crossing(sets: list[np.ndarray], weights: list[np.ndarray], component: list, side: np.ndarray, first: int, second: int, similar: float) -> list[tuple[int, int]]:
    """Links of `similar` or more between rows of side first and rows of side second, as many as join different components."""
    label = np.unique(np.array(component, dtype=object), return_inverse=True)[1]
    size = np.array([len(x) for x in sets])
    plain = np.array([w.max() == 1 for w in weights])
    total = np.array([w.sum() for w in weights], dtype=float)
    # rows of the largest component first, against the rest alone; then the rest against all
    inmost = label == np.bincount(label).argmax()  # as they come: labels change on the way
    out = []
    for inner in (True, False):
        mine = np.flatnonzero((side == first) & (inmost == inner))
        others = np.flatnonzero((side == second) & ~inmost) if inner else np.flatnonzero(side == second)
        if not len(mine) or not len(others):
            continue
        rows = np.repeat(others, size[others])
        h = np.concatenate([sets[i] for i in others])
        order = np.argsort(h, kind="stable")
        h, rows = h[order], rows[order]
        for i in mine.tolist():
            open_ = label != label[i]
            if not open_[others].any():
                continue
            low, high = np.searchsorted(h, sets[i], "left"), np.searchsorted(h, sets[i], "right")
            n = high - low
            met = rows[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            both = np.bincount(met, minlength=len(sets))
            sure = open_ & plain & plain[i] & (both >= similar * (size[i] + size - both))
            # with weights, the similarity is at most the weight of what both have in either
            perhaps = np.zeros(0, np.int64)
            if not (plain.all() or (plain[i] and plain[others].all())):
                share = np.bincount(met, np.repeat(weights[i], n), minlength=len(sets)) / total[i]
                perhaps = np.flatnonzero(open_ & ~(plain & plain[i]) & (share >= similar - 1e-9))
            for j in [*np.flatnonzero(sure).tolist(), *perhaps.tolist()]:
                if label[i] != label[j] and (sure[j] or similarity((sets[i], weights[i]), (sets[j], weights[j])) >= similar):
                    label[label == max(label[i], label[j])] = min(label[i], label[j])
                    out.append((i, j))
    return out


def in_blocks(open_: DataFrame, weighed: DataFrame, similar: float, block: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b, linked) for the links between components within each large band; its members are dealt in pairs of blocks.

    A band has as many blocks as keep each at about block members and block_bytes of shingles. Only ids are dealt; shingles are
    joined to what has been dealt.
    """
    sizes = weighed.select("node", (F.octet_length("h") + F.octet_length("w")).cast("long").alias("size"))
    bands = open_.select("band", "node").join(sizes, "node").groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    bands = common.stored(bands.select("band", "n", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") / block_bytes), F.lit(1)).cast("int").alias("blocks")), "neardup-block-counts")
    dealt = common.join_spread(open_.select("band", "node", "component"), bands, "band")
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "component").join(weighed, "node")

    def within(key, table):
        _, i, j = (k.as_py() for k in key)
        node = table.column("node").to_pylist()
        sets = [np.frombuffer(x, "<u8") for x in table.column("h").to_pylist()]
        weights = [np.frombuffer(w, "<u4") if w else np.ones(len(x), np.uint32) for x, w in zip(sets, table.column("w").to_pylist())]
        side = np.array(table.column("side").to_pylist())
        out = crossing(sets, weights, table.column("component").to_pylist(), side, i, j, similar) if (side == i).any() and (side == j).any() else []
        return pa.table({"a": pa.array([node[x] for x, _ in out], pa.binary()), "b": pa.array([node[y] for _, y in out], pa.binary()), "linked": pa.array([True] * len(out), pa.bool_())})

    return common.stored(dealt.repartition(common.parts(dealt.sparkSession), "band", "i", "j").groupBy("band", "i", "j").applyInArrow(within, "a binary, b binary, linked boolean"), "neardup-blocks")


def components_of(done: DataFrame, name: str) -> DataFrame:
    return common.components(done.where("linked").select("a", "b"), name)
