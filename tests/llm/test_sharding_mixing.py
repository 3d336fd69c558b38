import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palisade.llm import mixing, sharding


def test_shards_are_contiguous_and_near_equal(docs, rows):
    got = [r.asDict() for r in sharding.byte_shards(docs).collect()]
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
    for own in by_shard.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) <= 2 * largest
    order = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"], r["shard"]))
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in got)


def test_equal_rows_are_split_between_shards(spark):
    docs = spark.range(800).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.byte_shards(docs).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert sorted((r["shard"], r["n"], r["m"]) for r in got) == [(s, 100, 99) for s in range(8)]


def test_shard_column_follows_the_order(docs, rows):
    got = sharding.with_shard(docs).select("doc_id", "text", "shard", "key").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, *_ in rows)
    order = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["shard"] for r in order if r["doc_id"] != 30] == sorted(r["shard"] for r in got if r["doc_id"] != 30)


def test_empty_table(empty):
    assert sharding.byte_shards(empty).count() == 0
    assert sharding.with_shard(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(empty).columns == empty.columns


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            free.discard(s)
            left -= target[s]
    return target


def brute_taken(rows, target):
    sizes = Counter()
    for s, _, size in rows:
        sizes[s] += size
    limit = {}
    for s in sizes:
        if not sizes[s]:
            continue
        whole = int(target[s] // sizes[s])
        need, before = target[s] - whole * sizes[s], 0
        at = Counter()
        for s2, h, size in rows:
            if s2 == s:
                at[h] += size
        limit[s] = (whole, -1)
        for h in sorted(at):
            if before <= need < before + at[h]:
                limit[s] = (whole, h if (need - before) * 2 > at[h] else h - 1)
            before += at[h]
    return [(limit[s][0] + (h <= limit[s][1])) * size if s in limit else 0 for s, h, size in rows]


def brute_hashes(rows):
    """The hash of each row (doc_id, text, lang, source, ...), with the number of the copy."""
    digest = lambda x: "" if x is None else hashlib.md5(x.encode()).hexdigest()
    seen, out = Counter(), []
    for i, text, _, source, *_ in rows:
        named = f"{'' if i is None else i}|{digest(text)}|{digest(source)}|{seen[i, text, source]}"
        seen[i, text, source] += 1
        out.append(int(hashlib.md5(named.encode()).hexdigest()[:15], 16))
    return out


def test_mix_against_sorting(docs, rows):
    got = mixing.mix(docs).collect()
    sized = [(r[3], h, len((r[1] or "").encode().split()))
             for r, h in zip(rows, brute_hashes(rows), strict=True)]
    sizes = Counter()
    for s, _, size in sized:
        sizes[s] += size
    target = brute_targets(sizes)
    taken = brute_taken(sized, target)
    want = Counter((r[0], n, sizes[s], round(target[s], 6), t) for r, (s, _, n), t in zip(rows, sized, taken, strict=True))
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == want
    assert all(r["taken"] <= 3 * r["size"] for r in got)


@pytest.mark.parametrize("rows_of", ["null ids", "one id", "one row"])
def test_rows_that_share_an_id_come_near_the_target(spark, rows_of):
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(None if rows_of == "null ids" else 7).alias("doc_id"),
        F.concat(F.lit("two "), F.lit("same") if rows_of == "one row" else F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source")).repartition(6)
    got = mixing.mix(docs)
    sums = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(sums) == 2 and all(abs(r["taken"] - r["target"]) <= 2 for r in sums)
    mixed = {r["source"]: r["n"] * 2 for r in mixing.mixed_documents(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert sorted(mixed.values()) == sorted(r["taken"] for r in sums)


def test_mixed_documents_repeat_rows(docs):
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    got = Counter()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got[r["doc_id"]] += len((r["text"] or "").encode().split())
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}


def test_targets_stop_at_three_times(spark):
    docs = spark.createDataFrame([(i, "w " * (1 if i % 9 else 500), f"s{i % 9}") for i in range(90)], "doc_id long, text string, source string")
    got = {(r["source_size"], round(r["target"], 6)) for r in mixing.mix(docs).collect()}
    assert (10, 30.0) in got
