import os
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_grams import brute_grams
from test_sharding_mixing import brute_hashes, brute_taken, brute_targets
from test_simhash import brute_components, brute_fingerprint
from test_text_rules import brute_hits, brute_rules

from palisade.llm import quality_rules, queries

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def brute_quality(spark, docs, labels):
    """Rows that pass the base rules and whose n-grams (runs of three characters, pairs of words) reach the threshold."""
    weights = quality_rules.gram_weights(docs, quality_rules.trusted_ids(labels))
    rows = [tuple(r) for r in docs.collect()]
    every = {g for r in rows for g in brute_grams(r[1])}
    one = spark.createDataFrame([(g,) for g in every if isinstance(g, str)], "g string").select(
        "g", F.pmod(F.xxhash64("g"), F.lit(len(weights))).alias("b")).collect()
    two = spark.createDataFrame([g for g in every if isinstance(g, tuple)], "x string, y string").select(
        "x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(len(weights))).alias("b")).collect()
    bucket = {r["g"]: r["b"] for r in one} | {(r["x"], r["y"]): r["b"] for r in two}
    least = round(quality_rules.GRAM_THRESHOLD * quality_rules.SCALE)
    kept = []
    for r in rows:
        own = brute_grams(r[1])
        if not brute_rules(r[1])[-1] and sum(int(weights[bucket[g]]) for g in own) >= least * len(own):
            kept.append(r)
    return kept


def brute_dedup(rows):
    rows = sorted(rows, key=lambda r: r[0])
    label = brute_components([brute_fingerprint(r[1]) for r in rows])
    return [r for i, r in enumerate(rows) if label[i] == i]


@needs_tables
def test_stages_against_brute_force(spark, tmp_path):
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    docs, items = read("documents"), [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    rows = brute_quality(spark, docs, read("labels"))
    rows = brute_dedup(rows)
    rows = [r for r in rows if not brute_hits(r[1], items)[1]]
    sized = [(r[3], h, len((r[1] or "").encode().split()))
             for r, h in zip(rows, brute_hashes(rows), strict=True)]
    sizes = Counter()
    for s, _, n in sized:
        sizes[s] += n
    taken = brute_taken(sized, brute_targets(sizes))
    want = Counter({r: t // n for r, t, (_, _, n) in zip(rows, taken, sized, strict=True) if t})
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == [*docs.columns, "shard"]
    found = [tuple(r) for r in got.collect()]
    assert Counter(r[:-1] for r in found) == want
    assert [r[-1] for r in sorted(found, key=lambda r: r[0])] == sorted(r[-1] for r in found)
    bytes_of = Counter()
    for r in found:
        bytes_of[r[-1]] += len((r[1] or "").encode()) + 1
    mean = sum(bytes_of.values()) / 8
    assert set(bytes_of) == set(range(8)) and max(bytes_of.values()) < mean + 3 * max(len((r[1] or "").encode()) + 1 for r in found)


def test_stages_keep_columns_and_survive_odd_rows(spark, docs, empty, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "the and of no such thing")], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for data in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, data, str(tmp_path)).columns == data.columns
        last = corpus_pipeline.STAGES[-1][1](spark, data, str(tmp_path))
        assert last.count() == data.count()


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(want, key=repr)
