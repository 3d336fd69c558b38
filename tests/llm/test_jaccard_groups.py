import random

import pytest
from conftest import make_rows, prose

from palisade.llm import jaccard_groups


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute_classes(rows, least=90):
    """(doc_id, size of the set, least id of the class) of every row, by comparing all pairs."""
    sets, label = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, own in enumerate(sets):
        for j in range(i):
            if own and 100 * len(own & sets[j]) >= least * len(own | sets[j]):
                lo, hi = sorted((find(i), find(j)))
                label[hi] = lo
    least_id = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least_id[find(i)] = min(least_id.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least_id.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_copies(seed=7):
    """Groups of near copies of one and of several classes, chains, texts that share a passage."""
    rng = random.Random(seed)
    texts, passage = [], prose(rng, 40)
    for _ in range(4):
        base = prose(rng, rng.randint(90, 250)).split(" ")
        for _ in range(30):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            texts.append(" ".join(words))
    chain = prose(rng, 120).split(" ")
    for _ in range(15):
        chain = chain[4:] + prose(rng, 3).split(" ")
        texts.append(" ".join(chain))
    texts += [f"{prose(rng, 3)} {passage} {prose(rng, rng.randint(0, 3))}" for _ in range(40)]
    texts += [f"{prose(rng, 80)} {passage} {prose(rng, 80)}" for _ in range(40)]
    texts += [texts[0]] * 20 + ["one two", "One TWO", "one two three", "one", "", None, " ", "", "two one"]
    rows = list(enumerate(texts))
    rows += [(None, texts[3]), (None, "alone with no id"), rows[0], rows[0]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("part", [jaccard_groups.PART, 1500])
def test_against_all_pairs(spark, part):
    rows = near_copies()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, f1 long, label string").repartition(6)
    got = jaccard_groups.classes(docs, part=part)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute_classes(rows)
    assert len({c for *_, c in want}) < len({d for d, *_ in want}) - 80
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_odd_rows_against_all_pairs(docs, rows):
    got = jaccard_groups.classes(docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_classes([r[:2] for r in make_rows()])


def test_empty_table(empty):
    assert jaccard_groups.classes(empty).collect() == []


def test_group_opens_only_what_can_be_similar():
    import numpy as np

    group = jaccard_groups.Group([np.arange(0, 100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64)])
    assert group.linked(np.arange(2, 102, dtype=np.uint64)).tolist() == [0, 1]
    assert group.linked(np.arange(0, 97, dtype=np.uint64)).tolist() == [0]
    assert group.linked(np.arange(60, 160, dtype=np.uint64)).tolist() == []
    assert group.linked(np.zeros(0, np.uint64)).tolist() == []
