"""Phrases whose words keep company, by sampling with a negative border (Toivonen).

A phrase is a run of words of one piece of a text.  A phrase that occurs often enough has only
parts that do, so the search needs the phrases whose parts are frequent.  A sample of the documents
proposes which words and pairs are frequent, at a lowered threshold.  One pass over all documents
then counts exactly every proposed phrase and the negative border: the phrases that
were not proposed though all their parts were.  A border phrase that turns out frequent is a
failure: it may be part of phrases that were not counted.  Further passes count what the
failures admit, until there are none.

What is proposed reaches the tasks as a bitmap of phrase hashes of at most 2 ** 27 bits.  Two
phrases that share a bit only make the pass count more: counts are kept by the phrase itself and
the threshold is applied to them, so the result is exact whatever the sample and the bitmap are.

A task combines equal phrases of some half a million words before it hands them on, a row per phrase,
so a frequent phrase is few rows of the shuffle, and memory is bounded.

Edge cases: a null text is empty, a null language is `und`; texts without words count nothing;
repeated rows count each; a piece of any length is one piece, a text is worked through in blocks
of whole pieces; an empty table, or one without frequent phrases, gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.plans.storage import stored

# fixed values: what ends a piece, what separates words, what is lowered
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(_ENDS + b"\t" + bytes(range(65, 91)), b"\n" * len(_ENDS) + b" " + bytes(range(97, 123)))
LEAST, LONGEST, KEPT_PCT, TOP = 10, 3, 50, 2000
SHARE = 4  # a document in so many is sampled
LOWERED = 2  # occurrences in the sample that propose a phrase; the share of LEAST is 2.5
MOST_BITS = 27
WORDS_AT_ONCE, BLOCK = 500_000, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
COUNTS = "lang string, phrase string, f long"


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    own = a * _MIX[0] + (b ^ (b >> np.uint64(29))) * _MIX[1]
    return own ^ (own >> np.uint64(32))


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _Ids(dict):
    """Numbers words as they come; 0 ends a piece, 1 is no word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = own = len(self)
        return own


class Run:
    """The words of some texts of one language, as numbers."""

    def __init__(self, lang: str):
        self.lang, self.ids, self.parts, self.size = lang, _Ids({b"\n": 0, b"": 1}), [], 0

    def add(self, text: str) -> Iterator[bool]:
        """Takes a text in; stops after every block of it."""
        data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
        start = 0
        while start < len(data):
            stop = data.find(b"\n", start + BLOCK) if len(data) - start > BLOCK else -1
            stop = len(data) if stop < 0 else stop
            parts = (data[start:stop] + b"\n").replace(b"\n", b" \n ").split(b" ")
            own = np.fromiter(map(self.ids.__getitem__, parts), np.int64, len(parts))
            own = own[own != 1]
            self.parts.append(own)
            self.size += len(own)
            start = stop
            yield True

    def words(self) -> tuple[np.ndarray, list[str], np.ndarray]:
        """All numbers, the word of every number, its hash (with the language)."""
        names = [w.decode("utf-8", "surrogatepass") for w in self.ids]
        head = self.lang.encode("utf-8", "surrogatepass") + b"\x00"
        hashes = np.fromiter((xxhash.xxh64_intdigest(head + w) for w in self.ids), np.uint64, len(self.ids))
        return np.concatenate(self.parts), names, hashes


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[Run]:
    """Runs of bounded size, each of one language."""
    runs: dict[str, Run] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            run = runs.setdefault(lang, Run(lang))
            before = run.size
            for _ in run.add(text):
                total += run.size - before
                before = run.size
                if total >= WORDS_AT_ONCE:
                    yield from (r for r in runs.values() if r.size)
                    runs, total, before = {}, 0, 0
                    run = _moved(runs, run)
    yield from (r for r in runs.values() if r.size)


def _moved(runs: dict[str, Run], run: Run) -> Run:
    """The same language goes on with an empty run, the text being read included."""
    run.ids, run.parts, run.size = _Ids({b"\n": 0, b"": 1}), [], 0
    runs[run.lang] = run
    return run


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True) if len(codes) else (codes, codes.astype(np.int64))


def phrase_counts(run: Run, bitmap: np.ndarray, before: np.ndarray | None) -> list[pd.DataFrame]:
    """The phrases of a run whose parts are in the bitmap, but not all in the one before: lang, phrase, f.
    The empty phrase stands for all words.  After the first pass a pair that is counted for the first time
    counts as part of longer phrases at once, so that it needn't be proposed by another pass."""
    a, names, hashes = run.words()
    v = np.uint64(len(names))
    good = _has(bitmap, hashes)
    old = _has(before, hashes) if before is not None else None
    n = len(names)
    frames = []

    def give(phrases: list[str], f: np.ndarray) -> None:
        if len(f):
            frames.append(pd.DataFrame({"lang": run.lang, "phrase": phrases, "f": f}))

    if before is None:  # all words are counted in the first pass, and their number
        f = np.bincount(a, minlength=n)
        give([""], np.array([f[2:].sum()]))
        give(names[2:], f[2:])
    word = a > 1
    pair = word[:-1] & word[1:]
    x, y = a[:-1], a[1:]
    pair_hash = _pair_hash(hashes[x], hashes[y])
    want = pair & good[x] & good[y]
    if old is not None:
        want &= ~(old[x] & old[y])
    at = np.flatnonzero(want)
    codes, f = _counted(x[at].astype(np.uint64) * v + y[at].astype(np.uint64))
    first, second = (codes // v).astype(np.int64), (codes % v).astype(np.int64)
    give([f"{names[i]} {names[j]}" for i, j in zip(first.tolist(), second.tolist(), strict=True)], f)
    if len(a) > 2:
        # a pair is counted, and so a part, only if its words are in the bitmap as well
        known = pair & good[x] & good[y] & _has(bitmap, pair_hash)
        if old is not None:
            known |= want
        had = known & _has(before, pair_hash) & old[x] & old[y] if old is not None else np.zeros(len(x), bool)
        want = known[:-1] & known[1:] & ~(had[:-1] & had[1:])
        at = np.flatnonzero(want)
        codes, f = _counted((a[at].astype(np.uint64) * v + a[at + 1].astype(np.uint64)) * v + a[at + 2].astype(np.uint64))
        rest, third = codes // v, (codes % v).astype(np.int64)
        first, second = (rest // v).astype(np.int64), (rest % v).astype(np.int64)
        give([f"{names[i]} {names[j]} {names[k]}" for i, j, k in zip(
            first.tolist(), second.tolist(), third.tolist(), strict=True)], f)
    return frames


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.xxhash64(F.col("doc_id"), F.col("text")).alias("h"))


def _proposed(texts: DataFrame, share: int, lowered: int) -> DataFrame:
    """h of the words and pairs that occur often enough in the sampled documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in _runs(batches):
            a, _, hashes = own.words()
            pair = (a[:-1] > 1) & (a[1:] > 1)
            at = np.flatnonzero(pair)
            for found in (hashes[a[a > 1]], _pair_hash(hashes[a[at]], hashes[a[at + 1]])):
                h, n = _counted(found)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    sample = texts.where(F.pmod("h", F.lit(share)) == 0).select("lang", "text")
    return sample.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(
        F.col("n") >= lowered).select("h")


def _failed(phrases: DataFrame, bitmap) -> DataFrame:
    """h of the words and pairs (lang, phrase) that are not in the bitmap (a broadcast variable)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for lang, phrase in zip(batch["lang"], batch["phrase"], strict=True):
                own = np.array([xxhash.xxh64_intdigest(f"{lang}\x00{w}".encode("utf-8", "surrogatepass"))
                                for w in phrase.split(" ")], np.uint64)
                found.append(own[0] if len(own) == 1 else _pair_hash(own[:1], own[1:])[0])
            h = np.array(found, np.uint64)
            yield pd.DataFrame({"h": h[~_has(bitmap.value, h)].view(np.int64)})

    return phrases.select("lang", "phrase").mapInPandas(run, "h long")


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits of h (long), built on Spark in blocks; 2 ** bits of them at most come here."""
    at = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    block = F.shiftright(at, 15)
    # MOST_BITS bound the blocks: at most 4096 of 4096 bytes
    rows = hashes.groupBy(block.alias("block")).agg(
        F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << 15) - 1))).alias("own")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[r["block"] * 4096:(r["block"] + 1) * 4096] = np.frombuffer(bytes(r["own"]), np.uint8)
    return out


def frequent(
    docs: DataFrame, least: int = LEAST, share: int = SHARE, lowered: int = LOWERED, most_bits: int = MOST_BITS,
) -> DataFrame:
    """lang, k, phrase, f of all phrases of k = 1 to 3 words that occur `least` times or more,
    and with k = 0 the number of words of every language."""
    texts, spark = _texts(docs), docs.sparkSession
    proposed = stored(_proposed(texts, share, lowered))
    bits = min(most_bits, max(16, int(16 * proposed.count()).bit_length()))
    bitmap, before, found = _bitmap(proposed, bits), None, []
    while True:
        new, old = spark.sparkContext.broadcast(bitmap), spark.sparkContext.broadcast(before)

        def run(batches: Iterator[pd.DataFrame], new=new, old=old) -> Iterator[pd.DataFrame]:
            for own in _runs(batches):
                yield from phrase_counts(own, new.value, old.value)

        counts = texts.select("lang", "text").mapInPandas(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        length = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
        counts = stored(counts.where((F.col("f") >= least) | (F.col("phrase") == "")).withColumn("k", length))
        found.append(counts)
        # pairs of later passes have counted as parts already
        parts = counts.where(F.col("k").between(1, LONGEST - 1 if before is None else 1))
        failed = stored(_failed(parts, new))
        if failed.isEmpty():
            break
        bitmap, before = bitmap | _bitmap(failed, bits), bitmap
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return every.select("lang", "k", "phrase", "f")


def collocations(
    docs: DataFrame, least: int = LEAST, kept_pct: int = KEPT_PCT, top: int = TOP, share: int = SHARE,
    lowered: int = LOWERED, most_bits: int = MOST_BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two and three words of a language."""
    counts = stored(frequent(docs, least, share, lowered, most_bits))
    part = counts.where("k between 1 and 2").select("lang", F.col("phrase").alias("part"), F.col("f").alias("of"))
    words = F.split("phrase", " ")
    phrases = counts.where("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"), words.alias("w"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"))
    cuts = (cuts.join(part.select("lang", F.col("part").alias("head"), F.col("of").alias("l")), ["lang", "head"])
            .join(part.select("lang", F.col("part").alias("tail"), F.col("of").alias("r")), ["lang", "tail"]))
    # 38 digits hold the products up to 10 ** 15 occurrences; the quotient is whole
    wide = cuts.select("lang", "phrase", "a", "cut", "l", "r", F.expr(
        "(cast(1000000 as decimal(7,0)) * (cast(a as decimal(19,0)) * cast(a as decimal(19,0)))) "
        "div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").alias("score"))
    lowest = wide.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = phrases.where(F.col("k") == LONGEST).select(
        "lang", F.col("a").alias("longer"), F.explode(F.array(
            F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = lowest.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < kept_pct * F.col("a")))
    ranked = alone.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    sizes = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.where(F.col("rank") <= top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
