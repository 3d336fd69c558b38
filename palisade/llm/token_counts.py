"""Tokens of every document under a unigram vocabulary, without making the tokens.

A text is split before every space, written as the vocabulary writes it (a mark at the word's
beginning, one more in front of the text).  In each word an Aho-Corasick automaton reports all
vocabulary pieces by their end, longest first; the recurrence keeps, for each end, the best score
and the number of pieces of the best segmentation.  Ties go to the piece that begins first, as in the
tokenizer: candidates are tried longest first and replaced only by a greater score.  A character
that is no piece by itself may stand as an unknown one, 10 below the worst score;
it counts its UTF-8 bytes if the vocabulary has byte pieces, else adjacent unknown
characters count as one.

A BPE file's scores are ranks of merges, for which the recurrence gives counts of no tokenizer: `merged_counts`
applies the merges of such a file, best rank first and leftmost among equals, to runs of marks and the word after them.

Words repeat, so a task remembers their results, up to a fixed number of them.

Edge cases: null and empty texts have no tokens; repeated rows get a row each; an empty
table gives an empty result; other columns are ignored.  Memory is bounded by the longest text.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_BELOW = 10.0


def pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The pieces and scores of a model file, and whether it has byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in ids]
    normal = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not special[i]]
    return normal, sum(model.is_byte(i) for i in ids) == 256


class Counts:
    """Scores and token counts of words."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_pieces: bool, unknown: float,
                 remembered: int = 400_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        if vocabulary:
            self.automaton.make_automaton()
        self.empty = not vocabulary
        self.byte_pieces, self.unknown, self.remembered = byte_pieces, unknown, remembered
        self.known: dict[str, tuple[float, int]] = {}

    def word(self, word: str) -> tuple[float, int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            found = self.known[word] = self._best(word)
        return found

    def _best(self, word: str) -> tuple[float, int]:
        ending: list[list[tuple[int, float]]] = [[] for _ in word]
        if not self.empty:
            for end, entry in self.automaton.iter(word):
                ending[end].append(entry)
        scores, counts, unknown = [0.0], [0], [False]
        for end, entries in enumerate(ending):
            best = None
            for length, score in entries:  # longest first
                total = score + scores[end + 1 - length]
                if best is None or total > best[0]:
                    best = total, counts[end + 1 - length] + 1, False
            if not entries or entries[-1][0] != 1:
                total = self.unknown + scores[end]
                if best is None or total > best[0]:
                    one = len(word[end].encode()) if self.byte_pieces else int(not unknown[end])
                    best = total, counts[end] + one, True
            scores.append(best[0])
            counts.append(best[1])
            unknown.append(best[2])
        return scores[-1], counts[-1]

    def text(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        if not text.startswith((" ", MARK)):
            text = MARK + text
        # every mark begins a word
        words = text.replace(" ", MARK).split(MARK)
        score, count = 0.0, 0
        for word, times in Counter(words[1:]).items():
            s, n = self.word(MARK + word)
            score += s * times
            count += n * times
        return score, count


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, score (of the best segmentation) for every row of docs."""
    vocabulary, byte_pieces = pieces(model_path)
    # as the tokenizer does, special pieces (score 0) count for the worst score
    worst = min([0.0, *(score for _, score in vocabulary)])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the file's size bounds it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(shared.value, byte_pieces, worst - UNKNOWN_BELOW)
        for batch in batches:
            results = [counts.text(x) for x in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_tokens": [n for _, n in results],
                "score": [s for s, _ in results]})

    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(run, "doc_id string, n_tokens long, score double").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Merges:
    """Scores and token counts under the merges of a BPE model: a text is written with a mark in front."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_pieces: bool, remembered: int = 400_000):
        self.scores, self.byte_pieces, self.remembered = dict(vocabulary), byte_pieces, remembered
        # no merge goes from a letter to a mark, unless a piece does
        self.units = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.scores)
        self.known: dict[str, tuple[float, int]] = {}

    def unit(self, unit: str) -> tuple[float, int]:
        found = self.known.get(unit)
        if found is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            found = self.known[unit] = self._merged(unit)
        return found

    def _merged(self, unit: str) -> tuple[float, int]:
        if unit in self.scores and len(unit) == 1:
            return self.scores[unit], 1
        parts: list[str] = list(unit)  # a part that was merged into its left one is empty
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                both = parts[left] + parts[right]
                score = self.scores.get(both)
                if score is not None:
                    heapq.heappush(heap, (-score, left, right, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, both = heapq.heappop(heap)
            if not parts[left] or not parts[right] or parts[left] + parts[right] != both or after[left] != right:
                continue
            parts[left], parts[right] = both, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        score, count, unknown = 0.0, 0, False
        for part in filter(None, parts):
            own = self.scores.get(part)
            if own is not None:
                score, count = score + own, count + 1
            else:
                count += len(part.encode()) if self.byte_pieces else int(not unknown)
            unknown = own is None
        return score, count

    def text(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        text = MARK + text.replace(" ", MARK)
        score, count = 0.0, 0
        for unit, times in Counter(UNIT.findall(text) if self.units else [text]).items():
            s, n = self.unit(unit)
            score += s * times
            count += n * times
        return score, count


def merged_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, score (sum over the tokens) for every row of docs, as the BPE model itself encodes."""
    vocabulary, byte_pieces = pieces(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the file's size bounds it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merges = Merges(shared.value, byte_pieces)
        for batch in batches:
            results = [merges.text(x) for x in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_tokens": [n for _, n in results],
                "score": [s for s, _ in results]})

    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(run, "doc_id string, n_tokens long, score double").withColumn(
        "doc_id", F.col("doc_id").cast("long"))
