"""Benchmark passages in documents, found with a positional inverted index.

The index holds postings (term, document, position, neighbourhood) of the terms that
are asked for.  Every window of a test item is looked up by its rarest terms, by their
number of postings over all documents: the posting lists are adjusted by the term's
offset in the window, and their intersection on (window, document, start) gives the
candidates.  The neighbourhood stored with a posting, the words that any window
around it can need, tells whether the whole phrase stands there.  Proximity matches allow the
rarest terms to stand up to `slop` words off their places.

Counting terms and writing postings are two passes over the documents; a window term is found
by a broadcast of the asked terms, if their number was counted to be small, so
the tokens aren't shuffled.  A document's words are cut into overlapping chunks before they are
numbered, so a row never carries a whole long text.  Hits are grouped by (window,
document, start), which no frequent term can make large.

Edge cases: null texts and texts without a word have no hits and n_words 0; an item without
a word has no window; an item of fewer words than a window is one window; items that
repeat an id count once; the windows of an item without an id count for the words and the verdict of
a document, but the item is in no list of ids; repeated rows of documents get the same result each; a table without
items gives no hits; other columns are ignored or kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import cut, doc_key, small_side
from palisade.plans.storage import stored

# fixed values: between words, and a word before A-Z are lower-cased
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK = 64


def _lowered(text: Column) -> Column:
    """A-Z lower-cased; lower() does that in texts of ASCII, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def _tokens(text: Column) -> Column:
    """The words at their positions; an empty string may stand at the end."""
    return F.split(F.regexp_replace(_lowered(text), "^" + BETWEEN, ""), BETWEEN)


def windows(items: DataFrame, length: int = 10) -> DataFrame:
    """window_id, item_id, phrase: the windows of every item."""
    token = F.filter(_tokens(F.coalesce("text", F.lit(""))), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - length, F.lit(0)))
    return (
        items.select(F.col("item_id").cast("string").alias("item_id"), token.alias("w"))
        .where("size(w) > 0")
        .select("item_id", "w", F.explode(starts).alias("s"))
        .select("item_id", F.slice("w", F.col("s") + 1, F.lit(length)).alias("phrase"))
        .select(F.xxhash64("phrase").alias("window_id"), "item_id", "phrase").distinct()
    )


def rarest_terms(docs: DataFrame, phrases: DataFrame, lists: int = 2) -> DataFrame:
    """window_id, phrase, term, offset, nth, lists: of each window that all its terms
    allow, the `lists` entries with the fewest postings."""
    entries = phrases.select("window_id", "phrase", F.posexplode("phrase").alias("offset", "term"))
    vocabulary = small_side(entries.select("term").distinct())
    counts = (
        docs.select(F.explode(_tokens(F.col("text"))).alias("term"))
        .join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("postings"))
    )
    rank = Window.partitionBy("window_id").orderBy(F.col("postings").asc_nulls_first(), "offset")
    return (
        entries.join(small_side(counts), "term", "left")
        .withColumn("nth", F.row_number().over(rank))
        .withColumn("rarest", F.min(F.coalesce("postings", F.lit(0))).over(Window.partitionBy("window_id")))
        .where((F.col("nth") <= lists) & (F.col("rarest") > 0))
        .select("window_id", "phrase", "term", "offset", "nth",
                F.least(F.size("phrase"), F.lit(lists)).alias("lists"))
    )


def postings(docs: DataFrame, terms: DataFrame, length: int = 10) -> DataFrame:
    """The index, a row per posting (equal rows of docs repeat theirs): term, key, pos, around (the words that a window over pos can
    need) and left (how many of them stand before it)."""
    side = length - 1
    chunk = F.transform(
        F.sequence(F.lit(0), F.size("w") - 1, F.lit(CHUNK)),
        lambda s: F.struct(s.alias("s"), F.slice(
            "w", F.greatest(s - side, F.lit(0)) + 1,
            F.least(s, F.lit(side)) + CHUNK + side).alias("words")))
    lead = F.least(F.col("c.s"), F.lit(side))
    left = F.least(F.col("p"), F.lit(side))
    return (
        docs.where("text is not null")
        .select(doc_key(F.col("doc_id"), F.col("text")).alias("key"), _tokens(F.col("text")).alias("w"))
        .select("key", F.explode(chunk).alias("c"))
        .select("key", "c", F.posexplode("c.words").alias("p", "term"))
        .where((F.col("p") >= lead) & (F.col("p") < lead + CHUNK) & (F.col("term") != ""))
        .join(small_side(terms.select("term").distinct()), "term")
        .select("term", "key", (F.col("c.s") + F.col("p") - lead).alias("pos"), left.alias("left"),
                F.slice("c.words", F.col("p") - left + 1, left + length).alias("around"))
    )


def _adjusted(index: DataFrame, rarest: DataFrame) -> DataFrame:
    """Offset-adjusted entries: window_id, key, start, lists, whole (the phrase is there)."""
    at = F.col("left") - F.col("offset")
    here = F.slice("around", F.greatest(at, F.lit(0)) + 1, F.size("phrase")) == F.col("phrase")
    return (
        index.join(small_side(rarest), "term").where("pos >= offset")
        .select("window_id", "key", (F.col("pos") - F.col("offset")).alias("start"), "offset", "nth",
                "lists", (here & (at >= 0)).alias("whole"), F.size("phrase").alias("length"))
    )


def phrase_matches(index: DataFrame, rarest: DataFrame) -> DataFrame:
    """window_id, key, start, length of every exact occurrence."""
    return (
        _adjusted(index, rarest).groupBy("window_id", "key", "start", "lists", "length")
        .agg(F.bit_or(F.expr("shiftleft(1, nth - 1)")).alias("met"), F.max("whole").alias("whole"))
        .where("met = shiftleft(1, lists) - 1 and whole").select("window_id", "key", "start", "length")
    )


def proximity_matches(index: DataFrame, rarest: DataFrame, slop: int = 5) -> DataFrame:
    """window_id, key, start, other: places where the two rarest terms of a window stand
    within `slop` words of where the phrase would have them.  A band join: the starts
    are dealt into cells of slop + 1, and neighbouring cells are asked."""
    rows = _adjusted(index, rarest).where("lists >= 2")
    first = Window.partitionBy("window_id")
    rows = rows.withColumn("is_first", F.col("offset") == F.min("offset").over(first))
    cell = F.floor(F.col("start") / (slop + 1))
    a = rows.where("is_first").select("window_id", "key", "start", cell.alias("cell"))
    b = rows.where("not is_first").select(
        "window_id", "key", F.col("start").alias("other"),
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    return (a.join(b, ["window_id", "key", "cell"])
            .where(F.abs(F.col("start") - F.col("other")) <= slop).drop("cell").distinct())


def hits(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """key, n_hit, items (sorted ids) of every document that holds a window."""
    asked = cut(windows(items, length))
    rarest = cut(rarest_terms(docs, asked.select("window_id", "phrase").distinct()))
    index = stored(postings(docs, rarest, length))
    found = cut(phrase_matches(index, rarest))
    n_hit = (
        found.select("key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos"))
        .distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    )
    of_items = small_side(asked.select("window_id", "item_id"))
    ids = (
        found.select("key", "window_id").distinct().join(of_items, "window_id")
        .groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    return n_hit.join(ids, "key")


def contamination(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids) for every row of docs."""
    own = docs.select(
        "doc_id", doc_key(F.col("doc_id"), F.col("text")).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long").alias("n_words"))
    found = cut(hits(docs, items, length))
    return own.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_contaminated(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """docs without the documents that hold a window, with their own columns."""
    found = small_side(hits(docs, items, length).select("key"))
    return docs.join(found, doc_key(docs["doc_id"], docs["text"]) == found["key"], "left_anti")
