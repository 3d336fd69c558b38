import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palisade.llm import decontamination, quality_rules

WORD4 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_hits(text, items, length=10):
    words = WORD4.findall(lower_ascii(text or ""))
    hit, found = set(), set()
    for item_id, item in items:
        own = WORD4.findall(lower_ascii(item or ""))
        if not own:
            continue
        size = min(length, len(own))
        phrases = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in phrases:
                hit.update(range(i, i + size))
                found |= {str(item_id)} - {"None"}
    return len(words), len(hit), sorted(found)


@pytest.fixture(scope="module")
def items(rows):
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 40]
    out = [(1, " ".join(texts[0].split()[5:30])), (2, " ".join(texts[1].split()[0:10]).upper()),
           (10, " ".join(texts[2].split()[-12:])), (3, "never seen anywhere at all in any of these texts here"),
           (4, None), (5, ""), (6, " .,;"), (7, texts[3].split()[7]), (8, "the"), (None, texts[5]), (9, "a a a"),
           (7, " ".join(texts[4].split()[3:20])), (11, "changed"), (12, " ".join(texts[6].split()[3:14]).replace(" ", ", "))]
    return out


def test_hits_against_brute_force(spark, docs, rows, items):
    bench = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, window_id string")
    got = decontamination.contamination(docs, bench).collect()
    want = Counter((i, *(lambda b: (b[0], b[1], tuple(b[2])))(brute_hits(t, items))) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
    left = decontamination.without_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(
        (i, t) for i, t, *_ in rows if not brute_hits(t, items)[1])


def test_no_items_and_no_documents(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs, none).where("n_hit > 0 or size(items) > 0").count() == 0
    some = spark.createDataFrame([(1, "the and of")], "item_id long, text string")
    assert decontamination.contamination(empty, some).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "zero alpha one beta two"), (2, "alpha x y beta"), (3, "alpha " + "x " * 40 + "beta"), (4, "beta alpha one")],
        "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha one beta")], "item_id long, text string")
    phrases = decontamination.windows(items).select("window_id", "phrase").distinct()
    rarest = decontamination.rarest_terms(docs, phrases)
    index = decontamination.postings(docs, rarest)
    exact = decontamination.phrase_matches(index, rarest)
    assert [(r["start"], r["length"]) for r in exact.collect()] == [(1, 3)]
    near = decontamination.proximity_matches(index, rarest, slop=3)
    assert {r["key"] for r in near.collect()} >= {r["key"] for r in exact.collect()}
    assert near.select("key").distinct().count() in (2, 3)


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_base_rules_against_brute_force(docs, rows):
    weights = quality_rules.ngram_weights(docs, docs.select("doc_id").where("doc_id < 40").distinct())
    got = quality_rules.judged(docs, weights)
    assert got.columns[:-1] == docs.columns
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], r["text"], *(r["rules of row"][n] for n in names)) for r in got.collect()) == Counter(
        (i, t, *brute_rules(t)) for i, t, *_ in rows)


def test_ratio_against_brute_force(spark, docs, rows):
    trusted = docs.select("doc_id").where("doc_id < 40").distinct()
    weights = quality_rules.ngram_weights(docs, trusted, buckets=512)
    words = {w for _, t, *_ in rows for w in WORD.findall(t or "")}
    suffixes = spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", F.pmod(F.xxhash64(F.right("w", F.lit(3))), F.lit(512)).alias("b")).collect()
    bucket = {r["w"]: r["b"] for r in suffixes}
    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        own = [bucket[w] for w in WORD.findall(t or "")]
        raw.update(own)
        if i is not None and i < 40:
            target.update(own)
    ratio = [math.log((target[b] + 1) / (target.total() + 512)) - math.log((raw[b] + 1) / (raw.total() + 512)) for b in range(512)]
    assert max(abs(x - w / quality_rules.SCALE) for x, w in zip(ratio, weights, strict=True)) < 1e-5
    for r in quality_rules.judged(docs, weights, threshold=0.0).collect():
        own, rules = WORD.findall(r["text"] or ""), r["rules of row"]
        mean = sum(ratio[bucket[w]] for w in own) / max(1, len(own))
        assert abs(mean - rules["llr"]) < 1e-4
        if abs(mean) > 1e-4:
            assert rules["kept"] == (not rules["base_failed"] and mean > 0)


def test_quality_without_labels_or_documents(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality_rules.quality_kept(docs, none)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not brute_rules(r["text"])[-1] for r in docs.collect())
    assert quality_rules.quality_kept(empty, none).count() == 0
