"""Rules on text shape, and a log-likelihood ratio between trusted and raw text.

Base rules look at words, symbols, repeated lines and repeated windows of a text.  The ratio
compares two multinomials over hashed n-grams, all runs of three characters in every word and all
pairs of neighbouring words: `target` from trusted documents, `raw` from all documents.  A document's
score is the sum of log(p_target / p_raw) over its n-grams, divided by their number; it is
kept if no base rule fails and the score reaches a fixed threshold, set from labelled rows.
(`ngram_weights` and the default of `judged` look at the last characters of the words only.)  Weights are fixed-point
numbers, so a score doesn't depend on the order of the sum, and every document is
judged by the same comparison, without any draw.

The counts are partial sums by word and by bucket; at most `buckets` weights and one word for
each place of the table of frequent words reach the driver.  The base rules are judged row by row, with array functions.
The n-grams of `every_gram` are summed up in exploded rows, where a lambda would cost several times as much a word, and
joined to the rows by a hash of id and text: a shuffle of one row a document, with its columns as far as they are asked for.
Windows of a text are told apart by 64-bit hashes, built by doubling (1, 2, 4, 8 words).

Edge cases: a null text is an empty one: no words, base rule failed.  Without trusted
documents all weights are 0.  Repeated rows are judged alike; other columns are kept.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import SPACE, doc_key

SYMBOL = r"[#*$%&|<>]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
WINDOW = 8
SCALE = 1 << 20
# fixed value, from the labelled rows of sf0.001 to sf0.1 that pass the base rules: every good document
# is above -0.2, and 333 of the 335 others are below -0.3
GRAM_THRESHOLD = -0.3
SHORT = 64  # letters up to which a word's n-grams are cut out one by one
# pieces of a longer word: sixty of its runs in each
PIECE = rf"(?=({NOT_SPACE}{{3,62}})){NOT_SPACE}{{1,60}}"
# places for words whose weight is worked out beforehand, and how often such a word occurs at least:
# they decide on time only, any other word is cut into its n-grams where it stands
PLACES = 1 << 15
FREQUENT = 16


class Common(NamedTuple):
    """Frequent words by place (their hash modulo the number of places): hash, sum of the weights of their runs."""

    hashes: np.ndarray
    weights: np.ndarray


def _bucket(word: Column, buckets: int, n: int) -> Column:
    return F.pmod(F.xxhash64(F.right(word, F.lit(n))), F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame, rows: int = 20_000) -> DataFrame:
    """doc_id of at most `rows` documents labelled as good, by the order of a hash."""
    return (labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def ngram_weights(
    docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 16, n: int = 3, alpha: float = 1.0,
) -> np.ndarray:
    """The fixed-point log ratio of every bucket, from all words of docs and from
    those of the trusted documents (doc_id, a bounded number of rows)."""
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left")
    counts = (
        marked.select("good", F.explode(F.split(F.col("text"), SPACE)).alias("w")).where("w != ''")
        .groupBy(_bucket(F.col("w"), buckets, n).alias("bucket"))
        .agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    )
    return _log_ratio(counts, buckets, alpha)


def _log_ratio(counts: DataFrame | pd.DataFrame, buckets: int, alpha: float) -> np.ndarray:
    """Weights from bucket, raw, target; at most `buckets` rows."""
    counts = counts.toPandas() if isinstance(counts, DataFrame) else counts
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not target.sum():
        return np.zeros(buckets, np.int64)
    ratio = (np.log((target + alpha) / (target.sum() + alpha * buckets))
             - np.log((raw + alpha) / (raw.sum() + alpha * buckets)))
    return np.rint(ratio * SCALE).astype(np.int64)


def _spelled(word: Column) -> Column:
    """All runs of three characters of a word; a shorter word is one itself."""
    n = F.length(word)
    one = F.split(word, "")  # linear in the length, as substring isn't
    two = F.zip_with(one, F.slice(one, 2, n), lambda a, b: F.concat(a, b))
    three = F.zip_with(two, F.slice(one, 3, n), lambda a, b: F.concat(a, b))
    return (F.when(n <= 3, F.array(word))
            .when(n <= SHORT, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(word, i, F.lit(3))))
            .otherwise(F.slice(three, 1, n - 2)))


def _words(text: Column) -> Column:
    """`words`, with a split at one plain character, which needs no pattern."""
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " "), " "), "")


def _each(w: str) -> Column:
    """The words of a column to explode; a bare column would be split once more for a filter on its size."""
    return F.when(F.size(w) > 0, F.col(w))


def _first(value: Column) -> Column:
    """The value, worked out before what is exploded beside it: a plain expression would be put off
    until each of the exploded rows, a row number can't be."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _pair_bucket(a: Column, b: Column, buckets: int) -> Column:
    """A word that is its own neighbour counts as the same pair whatever the word, so runs of words are seen."""
    return F.pmod(F.when(a == b, F.xxhash64(F.lit(""), F.lit(""))).otherwise(F.xxhash64(a, b)), F.lit(buckets)).cast("int")


def _cut_buckets(word: Column, buckets: int) -> Column:
    return F.transform(_spelled(word), lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int"))


def _gram_counts(docs: DataFrame, trusted: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """word, raw, target, and bucket, raw, target of the pairs."""
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left"
    ).select("good", _words(F.col("text")).alias("w"))
    counted = [F.count("*").alias("raw"), F.count("good").alias("target")]
    return (marked.select("good", F.explode(_each("w")).alias("word")).groupBy("word").agg(*counted),
            marked.select("good", "w", F.posexplode(_each("w")).alias("i", "a"))
            .select("good", "a", F.get("w", F.col("i") + 1).alias("b")).where("b is not null")
            .groupBy(_pair_bucket(F.col("a"), F.col("b"), buckets).alias("bucket")).agg(*counted)
            .select("bucket", "raw", "target"))


def _bucket_counts(word: DataFrame, pairs: DataFrame, buckets: int) -> DataFrame:
    spelled = (word.select("raw", "target", F.explode(_spelled(F.col("word"))).alias("gram"))
               .select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("bucket"), "raw", "target"))
    return spelled.unionAll(pairs).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def gram_weights(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 16, alpha: float = 1.0) -> np.ndarray:
    """The fixed-point log ratio of every bucket, from all n-grams of docs and from those of
    the trusted documents (doc_id).  Runs of characters are cut once for each distinct word."""
    return _log_ratio(_bucket_counts(*_gram_counts(docs, trusted, buckets), buckets), buckets, alpha)


def gram_tables(
    docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 16, alpha: float = 1.0,
    places: int = PLACES, frequent: int = FREQUENT,
) -> tuple[np.ndarray, Common]:
    """gram_weights and, from the same counts, the most frequent word of each place."""
    word, pairs = _gram_counts(docs, trusted, buckets)
    h = F.xxhash64("word")
    # target is carried along, and the length asked only behind the count, so that both uses of the
    # counts are one shuffle
    best = (word.where(F.when(F.col("raw") >= frequent, F.length("word")) <= SHORT)
            .groupBy(F.pmod(h, F.lit(places)).alias("place"))
            .agg(F.max(F.struct("raw", "target", h.alias("h"), "word")).alias("best")))
    rows = _bucket_counts(word, pairs, buckets).select(
        "bucket", "raw", "target", F.lit(0).cast("long").alias("h"), F.array().cast("array<int>").alias("cut")
    ).unionAll(best.select(F.lit(-1), F.lit(0).cast("long"), F.lit(0).cast("long"), "best.h",
                           _cut_buckets(F.col("best.word"), buckets))).toPandas()
    found = rows[rows["bucket"] < 0]
    weights = _log_ratio(rows[rows["bucket"] >= 0], buckets, alpha)
    # no word has a zero as its hash at place 1, nor a one at place 0: these stand for an empty place
    common = Common(np.zeros(places, np.int64), np.zeros(places, np.int64))
    common.hashes[0] = 1
    if len(found):
        at = found["h"].to_numpy(np.int64) % places
        cut = found["cut"].tolist()
        starts = np.cumsum([0, *map(len, cut[:-1])])
        common.hashes[at] = found["h"]
        common.weights[at] = np.add.reduceat(weights[np.concatenate(cut).astype(np.int64)], starts)
    return weights, common


def _numbers(values: np.ndarray) -> Column:
    """Folded to one constant."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def _known_words(docs: DataFrame, common: Common) -> DataFrame:
    """hash of word, known (the sum of its weights): a local table, as constants of this length would stand in every
    description of a plan that the driver makes and keeps."""
    at = common.hashes % len(common.hashes) == np.arange(len(common.hashes))  # empty places aren't
    return docs.sparkSession.createDataFrame(pa.table({
        "hash of word": pa.array(common.hashes[at], pa.int64()), "known": pa.array(common.weights[at], pa.int64())}))


def _gram_totals(docs: DataFrame, weights: np.ndarray, common: Common | None) -> DataFrame:
    """Documents by `key`: the sum of the weights of all n-grams and their number, both as often as the document
    is repeated.  A document without words has no row.  One row a word, and one
    more for each run of a word that isn't in `common`: plain columns, as array functions with lambdas cost several times as much a word."""
    buckets = len(weights)
    rows = docs.select(_first(doc_key(F.col("doc_id"), F.col("text"))).alias("key"), _words(F.col("text")).alias("w"))
    rows = rows.select("key", "w", F.posexplode(_each("w")).alias("i", "word")).select(
        "key", "word", F.get("w", F.col("i") + 1).alias("next"), F.length("word").alias("size"),
        F.xxhash64("word").alias("h"))
    if common is None:
        rows = rows.withColumn("known", F.lit(None).cast("long"))
    else:
        rows = rows.join(F.broadcast(_known_words(docs, common)), F.col("h") == F.col("hash of word"), "left")
    rows = rows.select(
        "key", "word", "size", "known",
        _first(F.when(F.col("next").isNotNull(), _pair_bucket(F.col("word"), F.col("next"), buckets))).alias("pair"),
        _first(F.greatest(F.col("size") - 2, F.lit(1)) + F.col("next").isNotNull().cast("int")).alias("number"))
    # a long word in pieces, so that cutting out its runs stays linear in its length
    rows = rows.select("key", "known", "pair", "number", F.posexplode(
        F.when((F.col("size") <= SHORT) | F.col("known").isNotNull(), F.array("word"))
        .otherwise(F.regexp_extract_all("word", F.lit(PIECE), 1))).alias("j", "piece"))
    # run 0 of the first piece stands for the word itself: its pair, and all of its runs if they are known
    rows = rows.select("key", "known", "pair", "number", "piece", F.explode(F.sequence(
        F.when(F.col("j") == 0, 0).otherwise(1),
        F.when(F.col("known").isNotNull(), 0).otherwise(F.greatest(F.length("piece") - 2, F.lit(1))))).alias("run"))
    once = F.col("run") == 0
    bucket = F.when(once, F.col("pair")).otherwise(F.pmod(F.xxhash64(F.substring("piece", F.col("run"), F.lit(3))), F.lit(buckets)))
    # the table stands here once, outside of the sums: each mention would send a copy of it to every task,
    # and the driver spells it out in every description of the plan, with sums four times as often
    rows = rows.select(
        "key", F.get(_numbers(weights), bucket).alias("weight"),
        F.when(once, F.col("known")).alias("known"), F.when(once, F.col("number")).alias("number"))
    none = F.lit(0).cast("long")
    return rows.groupBy("key").agg(
        F.sum(F.coalesce("weight", none) + F.coalesce("known", none)).alias("total"),
        F.sum(F.coalesce("number", F.lit(0))).alias("n_grams"))


def _doubled(hashes: Column, step: int) -> Column:
    later = F.slice(hashes, step + 1, F.size(hashes))
    return F.zip_with(hashes, later, lambda a, b: F.xxhash64(a, b))


def judged(
    docs: DataFrame, weights: np.ndarray, n: int = 3, threshold: float = -1.0,
    least_words: int = 20, most_repeated_pct: int = 30, every_gram: bool = False, score_failed: bool = True,
    common: Common | None = None,
) -> DataFrame:
    """docs and the column `rules`, a struct of n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, llr (per word, or n-gram) and kept.  every_gram: the
    weights are those of gram_weights; `common`, from gram_tables, only saves time.
    score_failed=False gives no llr to documents that a base rule fails: it couldn't keep them."""
    names = docs.columns
    text = F.coalesce(F.col("row.text"), F.lit(""))
    # each step is a struct column beside the row, so no name of docs can clash
    step = docs.select(F.struct(*(docs[c] for c in names)).alias("row"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    step = step.select("row", _words(text).alias("w"), lines.alias("l"))
    if every_gram:
        own = [doc_key(F.col("row.doc_id"), F.col("row.text")).alias("key")]
    else:
        # folded to one constant of at most `buckets` numbers
        table = _numbers(weights)
        own = [F.aggregate("w", F.lit(0).cast("long"), lambda acc, w: acc + F.get(table, _bucket(w, len(weights), n))).alias("total"),
               F.size("w").cast("long").alias("n_grams")]
    step = step.select(
        "row", *own, F.transform("w", lambda w: F.xxhash64(w)).alias("h"), F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
    )
    kept = [c for c in step.columns if c != "h"]

    def seen(hashes, n):
        """Whether a window can repeat: in its second place every run of n words is one seen before."""
        return F.size(hashes) - F.size(F.array_distinct(hashes)) > F.lit(WINDOW - n)

    for n_done in (1, 2):
        step = step.select(*kept, _doubled(F.col("h"), n_done).alias("h"))
    step = step.select(*kept, F.when(seen("h", 4), F.slice(
        _doubled(F.col("h"), 4), 1, F.greatest(F.lit(0), F.col("n_words").cast("int") - WINDOW + 1))).alias("h"))
    # (hash, start) in order of the hash, only where some hash repeats
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    pairs = F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    step = step.select(*kept, F.when(repeats, F.sort_array(pairs)).alias("s"))
    again = F.transform("s", lambda x, k: F.when(
        (F.get("s", k - 1)["h"] == x["h"]) | (F.get("s", k + 1)["h"] == x["h"]), x["i"]))
    step = step.select(*kept, F.sort_array(F.array_compact(again)).alias("p"))
    covered = F.aggregate(
        F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(
            F.get("p", k + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda acc, x: acc + x)
    step = step.select(*kept, F.coalesce(covered, F.lit(0)).alias("n_repeat_words"))
    failed = ((F.col("n_words") < least_words)
              | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated_pct))
    # the row number makes this step opaque: a filter on the result that moved down through
    # the steps would work out each of them many times over
    failed = failed & (F.monotonically_increasing_id() >= 0)
    step = step.select(*kept, "n_repeat_words", failed.alias("failed"))
    if every_gram:
        totals = _gram_totals(docs, weights, common).withColumnRenamed("key", "key of totals")
        step = step.join(totals, F.col("key") == F.col("key of totals"), "left")
        step = step.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total", "n_grams")})
    if not score_failed:
        step = step.withColumns({c: F.when(~F.col("failed"), F.col(c)) for c in ("total", "n_grams")})
    enough = F.coalesce(F.col("total") >= F.col("n_grams") * int(round(threshold * SCALE)), F.lit(False))
    return step.select(
        *(F.col("row")[c].alias(c) for c in names),
        F.struct(
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            F.col("failed").alias("base_failed"),
            (F.col("total") / SCALE / F.greatest("n_grams", F.lit(1))).alias("llr"),
            (~F.col("failed") & enough).alias("kept")).alias("rules of row"))


def judged_by_grams(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs and the column `rules`, scored over all n-grams of the texts."""
    weights, common = gram_tables(docs, trusted_ids(labels))
    return judged(docs, weights, threshold=GRAM_THRESHOLD, every_gram=True, score_failed=False, common=common)


def quality_kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only."""
    return judged_by_grams(docs, labels).where(F.col("`rules of row`.kept")).select(*docs.columns)
