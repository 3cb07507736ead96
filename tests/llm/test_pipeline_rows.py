"""All rows of the pipeline against brute-force stages 2 to 5 over the output of stage 1."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import numpy as np
from test_operators import WORD, jaccard, library, unite

from loggrove.llm import common

SF = "/root/testdata/sf0.001"
BLACK = re.compile(r"[^\t-\r ]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def line_dedup(docs, least=50):
    runs, first = [], {}
    for d, text in docs.items():
        lines = text.split("\n")
        n = [len(BLACK.findall(x)) for x in lines]
        for i in range(len(lines)):
            for steps in (range(i, len(lines)), range(i, -1, -1)):  # the shortest runs from line i on, and back from it
                total = 0
                for j in steps:
                    total += n[j]
                    if total >= least:
                        a, b = min(i, j), max(i, j)
                        body = "\n".join(lines[a : b + 1])
                        runs.append((d, a, b, body))
                        first[body] = min(first.get(body, (d, a)), (d, a))
                        break
    gone = {(d, k) for d, a, b, body in runs if first[body] < (d, a) for k in range(a, b + 1)}
    out = {}
    for d, text in docs.items():
        lines = text.split("\n")
        left = [x for k, x in enumerate(lines) if (d, k) not in gone]
        if len(left) == len(lines) or BLACK.search("\n".join(left)):
            out[d] = "\n".join(left)
    return out


def similarity(a, b):
    """At most the weight in either of what both have; plain sets are counted."""
    both = a.keys() & b.keys()
    if a == b or min(sum(x[k] for k in both) / sum(x.values()) for x in (a, b)) < 0.8 - 1e-9:
        return float(a == b)
    return len(both) / len(a.keys() | b.keys()) if max(*a.values(), *b.values()) == 1 else jaccard(a, b)


def near_dedup(docs):
    sets = {}
    for d, text in docs.items():
        if w := BLACK.findall(text):
            sets[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    links = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8]
    return {d: docs[d] for d, c in unite(list(docs), links).items() if d == c}


def words(text):
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    return [(m[0], m.start(), m.end()) for m in TOKEN.finditer(lower)]


def decontaminate(docs, items, width=10):
    windows = set()
    for text in items:
        w = [x for x, _, _ in words(text or "")]
        windows |= {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)) if w}
    lengths, out = {len(x) for x in windows}, {}
    for d, text in docs.items():
        found = words(text)
        w = [x for x, _, _ in found]
        hit = sorted({k for n in lengths for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)})
        at, left = 0, []
        for x, k in enumerate(hit):
            if not x or hit[x - 1] < k - 1:
                left.append(text[at : found[k][1]])
            at = found[k][2]
        out[d] = "".join(left) + text[at:]
    return out


def tokens(docs):
    lib, out = library(WORD), {}
    for d, text in docs.items():
        ids = lib.encode(text, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        out[d] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), raw)
    return out


def test_all_rows(spark):
    first = corpus_pipeline.quality_classifier(spark, common.table(spark, SF, "documents"), SF).collect()
    docs = {r.doc_id: r.text or "" for r in sorted(first, key=lambda r: r.doc_id)}
    assert len(docs) == len(first)
    items = [r.text for r in common.table(spark, SF, "benchmark").collect()]
    lines = line_dedup(docs)
    near = near_dedup(lines)
    clean = decontaminate(near, items)
    assert lines != docs and len(near) < len(lines) and clean != near  # each stage has work here
    want = tokens(clean)
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(want)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in got} == want
