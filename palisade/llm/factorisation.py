"""Text quality by a factorisation machine.

Features of a text: hashed words (log counts, normalised to length 1), statistics of its
structure, and its recorded length.  The score is
    sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),
the sum over all pairs of features by the sum-of-squares identity, so it takes time linear in
the number of features that are set.

The model is fitted on a bounded number of labelled rows (`rows`, by the order of a hash of the
id), whose features, not texts, reach the driver.  Scoring is row by row; nothing is shuffled.

Edge cases: null and empty texts have no words and zero statistics and are scored; a null
recorded length is taken as 0; repeated rows get a row each; without any label all scores are 0.5;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS_LOW, LETTERS_UP, DIGITS = slice(97, 123), slice(65, 91), slice(48, 58)
SYMBOLS = [ord(c) for c in "#*$%&|<>"]
MARKS = [ord(c) for c in "!?.,;:"]


def structure(raw: bytes, parts: list[bytes], recorded: float) -> list[float]:
    """Shares and logarithms that describe a text."""
    if not parts:
        return [0.0] * 13 + [float(np.log1p(recorded))]
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total, n = len(raw), len(parts)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, int(seen[LETTERS_LOW].sum() + seen[LETTERS_UP].sum()))
    runs = sum(a == b for a, b in zip(parts, parts[1:], strict=False))
    return [
        float(np.log1p(n)), float(np.log1p(len(lines))), total / n / 10,
        seen[LETTERS_UP].sum() / letters, seen[DIGITS].sum() / total,
        seen[SYMBOLS].sum() / n, seen[33] / n, seen[MARKS].sum() / n, seen[124] / n,
        seen[128:].sum() / total, len(set(parts)) / n, runs / n,
        1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(recorded)),
    ]


def features(text: str | None, recorded: float, buckets: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Set buckets, their values, and the statistics."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    parts = raw.split()
    stats = structure(raw, parts, recorded)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0), stats
    crc = zlib.crc32
    hashed = np.fromiter((crc(p) for p in parts), np.int64, len(parts)) % buckets
    counts = np.bincount(hashed, minlength=buckets)
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at])
    return at, values / np.sqrt((values ** 2).sum()), stats


@dataclass
class Machine:
    buckets: int
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -5, 5) / 3

    def score(self, at: np.ndarray, values: np.ndarray, stats: list[float]) -> float:
        x = np.concatenate((values, self.standard(np.array(stats))))
        i = np.concatenate((at, self.buckets + np.arange(len(stats))))
        v = self.v[i]
        pairs = ((x @ v) ** 2 - (x ** 2) @ (v ** 2)).sum() / 2
        return float(1 / (1 + np.exp(-np.clip(self.bias + x @ self.w[i] + pairs, -30, 30))))


def fit(rows: pd.DataFrame, buckets: int, rank: int = 6, rounds: int = 60, batch: int = 128,
        rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Adam on the logistic loss; rows: at, values, stats, label."""
    stats = np.array(rows["stats"].tolist())
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    size = buckets + stats.shape[1]
    machine = Machine(buckets, mean, scale, 0.0, np.zeros(size), np.zeros((size, rank)))
    x = np.zeros((len(rows), size), np.float32)
    for r, (at, values) in enumerate(zip(rows["at"], rows["values"], strict=True)):
        x[r, np.asarray(at, np.int64)] = values
    x[:, buckets:] = machine.standard(stats)
    y = rows["label"].to_numpy(np.float32)
    rng = np.random.default_rng(seed)
    p = [np.zeros(1, np.float32), np.zeros(size, np.float32),
         rng.normal(0, 0.05, (size, rank)).astype(np.float32)]
    p[0][0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, s, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for to in range(0, len(x), batch):
            own, goal = x[order[to:to + batch]], y[order[to:to + batch]]
            sums, squares = own @ p[2], own ** 2
            z = p[0][0] + own @ p[1] + (sums ** 2 - squares @ p[2] ** 2).sum(axis=1) / 2
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal) / len(goal)
            slopes = [np.array([error.sum()], np.float32), own.T @ error + decay * p[1],
                      own.T @ (error[:, None] * sums) - (squares.T @ error)[:, None] * p[2] + decay * p[2]]
            step += 1
            for k, g in enumerate(slopes):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    machine.bias, machine.w, machine.v = float(p[0][0]), p[1], p[2]
    return machine


def _narrow(docs: DataFrame) -> DataFrame:
    recorded = F.col("n_chars") if "n_chars" in docs.columns else F.length("text")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.greatest(F.coalesce(recorded, F.lit(0)), F.lit(0)).cast("double").alias("recorded"))


def trained(docs: DataFrame, labels: DataFrame, rows: int = 4000, buckets: int = 2048) -> Machine | None:
    """A machine fitted on at most `rows` rows of labels (doc_id, label)."""
    chosen = (labels.where("label is not null and doc_id is not null")
              .groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [features(t, n, buckets) for t, n in zip(batch["text"], batch["recorded"], strict=True)]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "label": batch["label"], "at": [a for a, _, _ in own],
                "values": [v for _, v, _ in own], "stats": [s for _, _, s in own]})

    # at most `rows` ids of bounded length
    sample = (
        _narrow(docs).join(F.broadcast(chosen), "doc_id")
        .mapInPandas(run, "doc_id string, label int, at array<int>, values array<float>, stats array<double>")
        .limit(2 * rows).toPandas()
    )
    if sample.empty:
        return None
    return fit(sample.sort_values("doc_id", kind="stable", ignore_index=True), buckets)


def scores(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, score for every row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [
                0.5 if machine is None else machine.score(*features(t, n, machine.buckets))
                for t, n in zip(batch["text"], batch["recorded"], strict=True)]})

    return _narrow(docs).mapInPandas(run, "doc_id string, score double").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold
