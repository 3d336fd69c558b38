"""Toxic terms, misspelled ones included, and the context they stand in.

Lexicon: words and stems that tell toxic documents from others, learned from labelled rows.  They
form a trie; the Levenshtein automaton of a token, its states the rows of the edit-distance
table, is run over the trie, and a branch is left as soon as no entry of the row is within the allowed
distance.  Terms of 5 letters or more allow one edit; a term whose misspellings
turn up in documents that aren't toxic allows none.

Context: a hit between an opening and its closing quotation mark on a line counts less, near a word of
reporting less still; an address ("you") in the window makes it count more.  Evidence of unquoted hits
adds up (noisy or), quoted hits only count as the strongest of them.

The labelled rows are bounded (`rows`, by the order of a hash of the id); words are counted by
partial sums, and only terms with enough evidence reach the driver.  Words count whole, however long.  Scoring is row by row; a task remembers
beginnings of tokens that no term is near, up to a fixed number.

Edge cases: null and empty texts score the base rate; repeated rows get a row each; without labels
the lexicon is empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import cut

TOKEN = re.compile(r"\w+")
# fixed values: what opens and closes a quotation, reports, or addresses
CLOSING = {'"': '"', "“": "”", "”": "”", "„": "“”", "«": "»", "»": "«»", "‘": "’"}
QUOTE = re.compile("[\"“”„«»‘’]")
REPORTING = frozenset("said says wrote writes quoted quote called term word words".split())
ADDRESS = frozenset("you your youre".split())
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
HEAD = 5
REMEMBERED = 200_000  # heads and tokens a task remembers


def _stems(token: str) -> list[str]:
    """The word itself, marked with an end sign, and its beginnings."""
    return [token + "$", *(token[:k] for k in STEM_LENGTHS if k <= len(token))]


def _families(toxic: DataFrame) -> dict[int, int]:
    """Key -> family: texts that share one of four minima of hashes of 5-word sequences,
    as copies and near copies do, so a copied text doesn't testify twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            least = []
            for text in batch["text"]:
                words = (text or "").split()
                runs = [" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))]
                least.append([min(xxhash.xxh64_intdigest(r, seed) for r in runs) - (1 << 63) for seed in range(4)])
            yield pd.DataFrame({"key": batch["key"], "least": least})

    rows = toxic.mapInPandas(run, "key long, least array<long>").collect()  # bounded by the sample
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in rows:
        for seed, value in enumerate(r["least"]):
            parent[find((seed, value))] = find(r["key"])
    return {r["key"]: find(r["key"]) for r in rows}


def _terms(texts: DataFrame) -> DataFrame:
    """term, key, words: distinct words a term stands in, for every text and the terms of its whole words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                found = Counter(s for t in set(TOKEN.findall((text or "").lower())) for s in _stems(t))
                if found:  # a frame without rows has no column types
                    yield pd.DataFrame({"term": list(found), "key": key, "words": list(found.values())})

    return texts.mapInPandas(run, "term string, key long, words long")


def _misses(other: DataFrame) -> DataFrame:
    """term, misses: the texts that aren't toxic, by term; summed by batch first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["text"]:
                seen.update({s for t in set(TOKEN.findall((text or "").lower())) for s in _stems(t)})
                if len(seen) >= REMEMBERED:
                    yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})
                    seen = Counter()
            if seen:
                yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})

    return other.mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("misses"))


def lexicon(toxic: DataFrame, other: DataFrame, least: int = 3, precision: float = 0.9) -> dict[str, float]:
    """Terms (stems, or words that end in $) and their weights, from texts of both kinds
    (key, text).  A term needs so much evidence that among all terms of toxic texts
    less than one would have it by chance; only terms that have it leave Spark.  A stem stands for the
    longer ones, and is itself lengthened as long as that loses few texts."""
    n_toxic, n_other = toxic.count(), other.count()
    if not n_toxic or not n_other:
        return {}
    # two numbers for each row of the bounded sample
    families = toxic.sparkSession.createDataFrame(list(_families(toxic).items()), "key long, family long")
    found = cut(_terms(toxic).join(F.broadcast(families), "key").groupBy("term").agg(
        F.sum("words").alias("words"), F.count("*").alias("texts"), F.count_distinct("family").alias("own")))
    tried = found.count()
    per_word = math.log((n_toxic + n_other) / n_toxic)
    proof = F.lit(per_word) * F.col("words") * F.col("own") / F.col("texts")
    rows = (
        found.where((F.col("own") >= least) & (proof >= math.log(tried or 1)))
        .join(_misses(other), "term", "left").fillna(0, "misses")
        .where(F.col("own") >= precision * (F.col("own") + F.col("misses")))
        .select("term", "own", "misses").collect()
    )
    support = {r["term"]: r["own"] for r in rows}
    misses = {r["term"]: r["misses"] for r in rows}
    chosen: dict[str, float] = {}
    names = sorted(support)
    for term in sorted(support, key=lambda t: (len(t), t)):
        if any(term[:k] in support for k in range(1, len(term))):
            continue
        longer = []
        for name in names[bisect.bisect_left(names, term):]:
            if not name.startswith(term):
                break
            if support[name] >= 0.9 * support[term]:
                longer.append(name)
        best = max(longer, key=lambda t: (len(t), support[t], t))
        chosen[best] = (support[best] + 1) / (support[best] + misses[best] + 1.1)
    return chosen


class Trie:
    """The lexicon, and the search for the terms nearest to a token."""

    def __init__(self, weights: dict[str, float], exact_only: frozenset[str] = frozenset()):
        self.root: dict = {}
        self.most, self.longest = 0, 0
        for term, weight in weights.items():
            node, letters = self.root, term.rstrip("$")
            allowed = 0 if len(letters) < 5 or term in exact_only else 1
            self.most, self.longest = max(self.most, allowed), max(self.longest, len(letters))
            for letter in letters:
                node = node.setdefault(letter, {})
            # key 1: (term, weight, edits allowed, only as a whole word)
            node.setdefault(1, []).append((term, weight, allowed, term.endswith("$")))

    def told(self, token: str) -> str:
        """The letters that decide about a token: behind them no stem ends within the edits allowed, and a
        token of more letters than these is as far from every whole word as these are."""
        return token[:self.longest + self.most + 1]

    def _walk(self, token: str) -> Iterator[tuple[dict, list[int]]]:
        """Nodes and the edit distances from their letters to every beginning of the token, as
        long as one of them is within the bound."""
        stack = [(self.root, list(range(len(token) + 1)), "", None)]
        while stack:
            node, row, last, before = stack.pop()
            yield node, row
            for letter, child in node.items():
                if letter == 1:
                    continue
                new = [row[0] + 1]
                for i, own in enumerate(token):
                    cost = min(new[i] + 1, row[i + 1] + 1, row[i] + (own != letter))
                    if before is not None and i and own == last and token[i - 1] == letter:
                        cost = min(cost, before[i - 1] + 1)  # two letters swapped
                    new.append(cost)
                if min(new) <= self.most:
                    stack.append((child, new, letter, row))

    def may_begin(self, head: str) -> bool:
        """Whether a token that begins so, and goes on, can be near a term."""
        return any(row[-1] <= self.most or any(min(row) <= allowed and not whole for _, _, allowed, whole in node.get(1, ()))
                   for node, row in self._walk(head))

    def nearest(self, token: str) -> tuple[str, float, int] | None:
        """The term that fits best (fewest edits, then heaviest): term, weight, edits."""
        best: tuple[int, float, str] | None = None
        token = self.told(token)
        for node, row in self._walk(token):
            for term, weight, allowed, whole in node.get(1, ()):
                edits = row[-1] if whole else min(row)  # a stem may be followed by anything
                if edits <= allowed and (best is None or (edits, -weight, term) < best):
                    best = edits, -weight, term
        return None if best is None else (best[2], -best[1], best[0])


def _quotations(text: str) -> list[tuple[int, int]]:
    """Begins and ends of the quotations of a text, in order: an opening mark and the next mark that closes it
    on the same line.  Marks between letters are apostrophes, marks that nothing closes are left out."""
    found, at, line_end, lost = [], 0, -1, set()
    while mark := QUOTE.search(text, at):
        at, own = mark.end(), mark.group()
        if own not in CLOSING or _inside_word(text, mark.start()):
            continue
        if mark.start() >= line_end:
            line_end, lost = text.find("\n", at), set()
            line_end = len(text) if line_end < 0 else line_end
        if own in lost:
            continue
        end = next((m.start() for m in QUOTE.finditer(text, at, line_end)
                    if m.group() in CLOSING[own] and not _inside_word(text, m.start())), None)
        if end is None:
            lost.add(own)  # nor does anything close a later one
        else:
            found.append((mark.start(), end))
            at = end + 1
    return found


def _inside_word(text: str, at: int) -> bool:
    return text[at] in "‘’" and 0 < at < len(text) - 1 and text[at - 1].isalnum() and text[at + 1].isalnum()


class Scorer:
    def __init__(self, weights: dict[str, float], base: float, exact_only: frozenset[str] = frozenset(),
                 window: int = 6):
        self.trie, self.base, self.window = Trie(weights, exact_only), base, window
        self.heads: dict[str, bool] = {}
        self.known: dict[str, tuple[str, float, int] | None] = {}

    def _term(self, token: str) -> tuple[str, float, int] | None:
        head = token[:HEAD]
        if len(head) == HEAD:  # most tokens end here
            may = self.heads.get(head)
            if may is None:
                if len(self.heads) >= REMEMBERED:
                    self.heads.clear()
                may = self.heads[head] = self.trie.may_begin(head)
            if not may:
                return None
        token = self.trie.told(token)
        if token not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[token] = self.trie.nearest(token)
        return self.known[token]

    def hits(self, lowered: str) -> dict[str, tuple[str, float, int]]:
        """The distinct tokens of a text that are terms: term, weight, edits."""
        found = ((token, self._term(token)) for token in set(TOKEN.findall(lowered)))
        return {token: hit for token, hit in found if hit is not None}

    def score(self, text: str | None) -> tuple[float, int, int, int]:
        """Score, hits, misspelled hits, quoted hits."""
        lowered = (text or "").lower()
        found = self.hits(lowered)
        if not found:
            return self.base, 0, 0, 0
        marks, quotations = list(TOKEN.finditer(lowered)), _quotations(lowered)
        miss, strongest, n, wrong, quoted = 1 - self.base, 0.0, 0, 0, 0
        for i, mark in enumerate(marks):
            hit = found.get(mark.group())
            if hit is None:
                continue
            _, weight, edits = hit
            near = {m.group() for m in marks[max(0, i - self.window):i + self.window + 1]}
            weight *= 0.75 ** edits
            if near & ADDRESS:
                weight = min(0.99, weight * 1.1)
            n, wrong = n + 1, wrong + (edits > 0)
            around = bisect.bisect(quotations, (mark.start(), 0)) - 1
            if around >= 0 and mark.end() <= quotations[around][1]:
                quoted += 1
                strongest = max(strongest, weight * (0.3 if near & REPORTING else 0.45))
            else:
                miss *= 1 - weight
        return 1 - miss * (1 - strongest), n, wrong, quoted


def trained(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> Scorer:
    """A scorer from at most `rows` rows of labels (doc_id, label)."""
    chosen = (labels.where("label is not null and doc_id is not null")
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # at most `rows` rows of two numbers; copies of a text count once
    sample = cut(
        docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
        .groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"), F.max("label").alias("label")))
    toxic = sample.where("label = 1").select("key", "text")
    other = sample.where("label != 1").select("key", "text")
    weights = lexicon(toxic, other)
    base = 0.02
    first = Scorer(weights, base)

    def misspelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["text"]:
                seen.update({term for term, _, edits in first.hits((text or "").lower()).values() if edits})
            if seen:
                yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})

    # terms whose neighbours are ordinary words allow no edit
    ordinary = (other.mapInPandas(misspelled, "term string, n long")
                .groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") > 0.0005 * other.count()).collect())
    return Scorer(weights, base, frozenset(r["term"] for r in ordinary))


def scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score, n_terms, n_misspelled, n_quoted for every row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [scorer.score(x) for x in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "score": [x[0] for x in own], "n_terms": [x[1] for x in own],
                "n_misspelled": [x[2] for x in own], "n_quoted": [x[3] for x in own]})

    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(
        run, "doc_id string, score double, n_terms long, n_misspelled long, n_quoted long"
    ).withColumn("doc_id", F.col("doc_id").cast("long"))
