import re
from collections import Counter, defaultdict

import pytest

from palisade.llm import collocations

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        scored = []
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    inside[part] = max(inside[part], a)
        for p, a in candidates.items():
            if 100 * inside[p] >= 50 * a and inside[p]:
                continue
            cuts = [(1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def texts(rows):
    own = [(r[2] if i % 9 else None, r[1]) for i, r in enumerate(rows)]
    own += [("fr" if i % 2 else "en", "New York City, new york. The cat sat; the cat sat!\nthe cat\vsat on it? a a a a") for i in range(25)]
    own += [("de", f"w{i} and w{i} and x{i % 7} y{i % 7}\tz{i % 3}") for i in range(120)]
    return own + [("es", ""), ("es", None), (None, "ÉTÉ été Été")]


@pytest.mark.parametrize("share,lowered,bits", [(4, 2, 27), (10**9, 2, 16), (3, 4, 27), (1, 1, 17), (2, 30, 16)])
def test_against_brute_force(spark, texts, share, lowered, bits):
    docs = spark.createDataFrame([(i, t, lang, "x", 0) for i, (lang, t) in enumerate(texts)],
                                 "doc_id long, text string, lang string, phrase string, k int").repartition(5)
    got = collocations.collocations(docs, share=share, lowered=lowered, most_bits=bits)
    want = brute(texts)
    assert len(want) > 20
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sorted(tuple(r) for r in collocations.collocations(docs, top=3, share=share).collect()) == brute(texts, top=3)


def test_runs_of_bounded_size(spark, texts, monkeypatch):
    monkeypatch.setattr(collocations, "WORDS_AT_ONCE", 40)
    monkeypatch.setattr(collocations, "BLOCK", 50)
    import pandas as pd

    batch = pd.DataFrame(texts, columns=["lang", "text"]).fillna("")
    n = Counter()
    for run in collocations._runs(iter([batch])):
        for frame in collocations.phrase_counts(run, collocations.np.full(64, 255, collocations.np.uint8), None):
            for row in frame.itertuples():
                n[row.lang, row.phrase] += row.f
    want = Counter()
    for lang, text in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                want.update(((lang or "", " ".join(words[i:i + k])) for i in range(len(words) - k + 1)))
    assert {k: v for k, v in n.items() if k[1]} == dict(want)


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", 0, "", 10**15), ("en", 1, "a", 3 * 10**14), ("en", 1, "b", 10**14), ("en", 2, "a b", 10**14 - 1)],
        "lang string, k int, phrase string, f long")
    original, collocations.frequent = collocations.frequent, lambda *a: counts
    try:
        (r,) = collocations.collocations(spark.createDataFrame([], "x int")).collect()
    finally:
        collocations.frequent = original
    assert r["score"] == 1_000_000 * (10**14 - 1) ** 2 // (3 * 10**28)


def test_empty_table(empty):
    assert collocations.collocations(empty).collect() == []
