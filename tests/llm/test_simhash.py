import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import simhash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=3):
    label = list(range(len(fps)))
    a = np.array(fps, np.uint64)
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            near = np.flatnonzero(np.bitwise_count(a ^ a[i]) <= bits)
            low = min(label[j] for j in near)
            for j in near:
                if label[j] != low:
                    label[j], changed = low, True
    return label


def test_against_brute_force(docs):
    got = simhash.near_copies(docs.select("doc_id", "text")).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    for r in got:
        assert r["fp"] & (2**64 - 1) in {brute_fingerprint(t) for t in texts[r["doc_id"]]}
    assert len(got) == docs.count()
    label = brute_components([r["fp"] & (2**64 - 1) for r in got])
    least = {}
    for r, c in zip(got, label, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert [r["component_id"] for r in got] == [least.get(c) for c in label]


@pytest.mark.parametrize("leaf", [4, 20, 5000])
def test_trees_lose_no_link(spark, leaf):
    rng = np.random.default_rng(leaf)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 500)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    tight = base[0] ^ np.array([(1 << i) | (1 << j) for i in range(20) for j in range(20)], np.uint64)
    every = np.unique(np.concatenate((base, near, tight))).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in every], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, leaf=leaf)).collect()}
    got = [roots.get(int(x), int(x)) for x in every]
    want = brute_components([int(x) & (2**64 - 1) for x in every])
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_long_chain_becomes_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_forest_keeps_components(edges):
    a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        lo, hi = sorted((find(x), find(y)))
        parent[hi] = lo
    node, root = simhash.forest(a, b) if edges else (a, b)
    got = dict(zip(node.tolist(), root.tolist(), strict=True))
    assert all(got.get(x, x) == find(x) for x in parent)


def test_one_row_of_each_group_stays(docs):
    got = simhash.without_near_copies(docs)
    assert got.columns == docs.columns
    found = simhash.near_copies(docs).collect()
    kept = [r["doc_id"] for r in got.collect()]
    assert sorted(x for x in kept if x is not None) == sorted({r["component_id"] for r in found} - {None})
    assert kept.count(None) == len({r["fp"] for r in found if r["component_id"] is None})


def test_empty_table(empty):
    assert simhash.near_copies(empty).count() == 0
    assert simhash.without_near_copies(empty).count() == 0
