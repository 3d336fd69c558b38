import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import quality_rules

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_grams(text):
    own = WORD.findall(text or "")
    return [w[i:i + 3] for w in own for i in range(max(1, len(w) - 2))] + [("", "") if x == y else (x, y) for x, y in zip(own, own[1:])]


def test_all_grams_against_brute_force(spark, docs, rows):
    trusted = docs.select("doc_id").where("doc_id < 40").distinct()
    weights = quality_rules.gram_weights(docs, trusted, buckets=512)
    every = sorted({g for _, t, *_ in rows for g in brute_grams(t)}, key=str)
    single = spark.createDataFrame([(g,) for g in every if isinstance(g, str)], "g string").select(
        "g", F.pmod(F.xxhash64("g"), F.lit(512)).alias("b")).collect()
    double = spark.createDataFrame([g for g in every if isinstance(g, tuple)], "x string, y string").select(
        "x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(512)).alias("b")).collect()
    bucket = {r["g"]: r["b"] for r in single} | {(r["x"], r["y"]): r["b"] for r in double}
    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        own = [bucket[g] for g in brute_grams(t)]
        raw.update(own)
        if i is not None and i < 40:
            target.update(own)
    ratio = [math.log((target[b] + 1) / (target.total() + 512)) - math.log((raw[b] + 1) / (raw.total() + 512)) for b in range(512)]
    assert max(abs(x - w / quality_rules.SCALE) for x, w in zip(ratio, weights, strict=True)) < 1e-5
    for r in quality_rules.judged(docs, weights, threshold=0.0, every_gram=True).collect():
        own = [ratio[bucket[g]] for g in brute_grams(r["text"])]
        assert abs(sum(own) / max(1, len(own)) - r["rules of row"]["llr"]) < 1e-4


@pytest.mark.parametrize("places", [1, 64, 1 << 12])
def test_frequent_words_only_save_time(spark, docs, places):
    """The table of frequent words is part of the counts, and every place of it leads to the same verdicts."""
    trusted = docs.select("doc_id").where("doc_id < 40").distinct()
    weights, common = quality_rules.gram_tables(docs, trusted, buckets=512, places=places, frequent=2)
    assert list(weights) == list(quality_rules.gram_weights(docs, trusted, buckets=512))
    assert len(common.hashes) == places and sum(h % places == i for i, h in enumerate(common.hashes.tolist())) > places / 8
    plain, quick = (quality_rules.judged(docs, weights, threshold=0.0, every_gram=True, common=c) for c in (None, common))
    assert plain.count() == quick.count() == docs.count()
    assert plain.exceptAll(quick).count() == 0


def test_words_are_weighed_without_lambdas(spark, docs):
    """No array function with a lambda, no second copy of the table and no second split of the texts on the way to a score."""
    plan = quality_rules.judged(docs, np.arange(8) + 1000001, every_gram=True)._jdf.queryExecution().optimizedPlan().toString()
    found = [x for x in plan.splitlines() if "[1000001,1000002" in x]
    assert plan.count("[1000001,1000002") == 1 and "lambda" not in found[0]
    counts = quality_rules._gram_counts(docs, docs.select("doc_id").limit(3), 512)
    plans = [plan, *(c._jdf.queryExecution().optimizedPlan().toString() for c in counts)]
    assert not [x for p in plans for x in p.splitlines() if "Filter" in x and "split(" in x]


def test_descriptions_of_plans_stay_short(spark, docs):
    """The words known beforehand stand in no description that the driver makes of a plan, and the weights once, not in each sum."""
    common = quality_rules.Common(np.arange(8) + 8000000, np.arange(8) + 5000001)
    for known in (None, common):
        judged = quality_rules.judged(docs, np.arange(8) + 1000001, every_gram=True, common=known)
        plan = judged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("1000001,1000002") == 1
        assert "8000000,8000001" not in plan and "5000001,5000002" not in plan


def test_empty_places_know_no_word(spark):
    """Places without a frequent word are no rows beside a word, whatever its hash."""
    docs = spark.createDataFrame([(1, "one two three " * 9), (2, None), (2, "one")], "doc_id long, text string")
    h = {r["w"]: r["h"] for r in spark.createDataFrame([("one",), ("two",)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    weights = np.arange(16) * quality_rules.SCALE
    plain = quality_rules.judged(docs, weights, every_gram=True)
    hashes, sums = np.full(64, h["two"]), np.zeros(64, np.int64)
    hashes[h["two"] % 64], hashes[h["one"] % 64] = 0, h["one"]  # "two" only at places that aren't its own
    sums[h["one"] % 64] = sum(int(weights[r["b"]]) for r in spark.createDataFrame([("one",)], "g string").select(
        F.pmod(F.xxhash64("g"), F.lit(16)).alias("b")).collect())
    quick = quality_rules.judged(docs, weights, every_gram=True, common=quality_rules.Common(hashes, sums))
    assert quick.count() == 3 and plain.exceptAll(quick).count() == 0


def test_long_words_lose_no_run(spark):
    """Words around the limits of the pieces, repeated rows and ids, and a word known beforehand among others."""
    letters = "".join(chr(97 + i * i % 23) + chr(945 + i * 7 % 19) for i in range(100))
    texts = [" ".join([letters[:n], "ab", letters[:n], "c"]) for n in (1, 2, 3, 4, 59, 60, 61, 62, 63, 64, 65, 66, 120, 121, 122, 123, 124, 125, 182)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (4, texts[5]), (None, texts[6]), (None, texts[6]), (None, None), (7, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = np.random.default_rng(5).integers(-9 * quality_rules.SCALE, 9 * quality_rules.SCALE, 64)
    every = sorted({g for _, t in rows for g in brute_grams(t)}, key=str)
    single = spark.createDataFrame([(g,) for g in every if isinstance(g, str)], "g string").select(
        "g", F.pmod(F.xxhash64("g"), F.lit(64)).alias("b"), F.xxhash64("g").alias("h")).collect()
    double = spark.createDataFrame([g for g in every if isinstance(g, tuple)], "x string, y string").select(
        "x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(64)).alias("b")).collect()
    bucket = {r["g"]: r["b"] for r in single} | {(r["x"], r["y"]): r["b"] for r in double}
    hashes = {r["g"]: r["h"] for r in single}
    known = quality_rules.Common(np.array([hashes["ab"]]), np.array([weights[bucket["ab"]]]))
    for common in (None, known):
        got = quality_rules.judged(docs, weights, every_gram=True, common=common).select("doc_id", "text", "rules of row.llr").collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(rows, key=str)
        for r in got:
            own = [int(weights[bucket[g]]) for g in brute_grams(r["text"])]
            assert abs(sum(own) / quality_rules.SCALE / max(1, len(own)) - r["llr"]) < 1e-9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_junk_is_seen_wherever_it_stands(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    weights = quality_rules.gram_weights(docs, quality_rules.trusted_ids(labels))
    marks = F.regexp_replace("text", r"([^\x20\x09-\x0D]*?)([$&%#*]{3})(?=[\x20\x09-\x0D]|$)", "$2$1")
    own = docs.join(labels, "doc_id").select("doc_id", "text", "quality")
    moved = own.where("quality = 0").withColumn("text", marks).where(F.col("text").rlike(r"[$&%#*]{3}\w"))

    def kept(table):
        rules = quality_rules.judged(table, weights, threshold=quality_rules.GRAM_THRESHOLD, every_gram=True).where(
            "not `rules of row`.base_failed")
        return [r["k"] for r in rules.select(F.col("rules of row")["kept"].alias("k")).collect()]

    found = kept(moved)
    assert len(found) > 5 and not any(found)
    assert not any(kept(own.where("quality = 0")))  # with a run of words among them
    assert all(kept(own.where("quality = 1")))
