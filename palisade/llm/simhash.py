"""Near copies by SimHash, found with vantage-point trees.

Every text gets a 64-bit fingerprint from its word shingles.  Two fingerprints
that differ in at most `bits` bits differ in at most bits // 2 of one half, so
there is one tree per 32-bit half, with radius bits // 2.  An inner node is a
vantage point and the median Hamming distance to it: points within the median
go left, the others right.  A fingerprint is stored in the one leaf it falls into,
and asked in every leaf that can hold a neighbour: by the triangle inequality
one side is pruned unless its distance is within the radius of the median.  Leaves are the
shards; inside a shard full fingerprints are compared exactly, in blocks.

The trees are fitted on a bounded sample of fingerprints; all fingerprints are indexed
and asked.  Fingerprints that many texts share are collapsed first, so a group of equal
copies is one row whatever its size.  A leaf with too many points is split by a hash
of the points, its questions going to each part.  A shard returns a spanning forest of its
links, not the links; the components of the union of all forests are those of all links.
Components are joined by alternating large-star and small-star steps, cut after each.

Edge cases: texts without a word (null, empty, blank) have fingerprint 0, which links as any
other; fewer words than a shingle give one shingle of all of them; rows with a null id
join components, whose id is the least of the ids that are there (null if there are none);
repeated rows give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import cut, doc_key, small_side

SEED = 42
HALVES = (32, 0)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text: a bit is set if it is in over half the hashes."""
    # bytes.lower changes A-Z only, bytes.split takes \\x20 and \\x09-\\x0D
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()
    last = min(shingle, len(parts)) - 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # bounded memory for any text
        to = min(n, at + 65_536)
        hashes = np.fromiter(
            (digest(joined[i:j], SEED)
             for i, j in zip(starts[at:to], stops[at + last:to + last], strict=True)),
            np.uint64, to - at)
        counts += np.unpackbits(
            hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        ).sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, key (of id and text), fp (the 64 bits as a long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = np.array([fingerprint(x, shingle) for x in batch["text"]], np.uint64)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "key": batch["key"], "fp": own.view(np.int64)})

    narrow = docs.select(
        F.col("doc_id").cast("long").cast("string").alias("doc_id"),  # keeps nulls whole in pandas
        doc_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(run, "doc_id string, key long, fp long").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


@dataclass(frozen=True)
class Tree:
    """A complete binary tree in an array; node i has children 2i+1 and 2i+2.
    A node without a vantage point (median -1) sends everything left."""

    depth: int
    points: np.ndarray
    medians: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, seed: int = 7) -> Tree:
        rng = np.random.default_rng(seed)
        inner = 2 ** depth - 1
        points, medians = np.zeros(inner, np.uint32), np.full(inner, -1, np.int16)
        members = {0: sample}
        for node in range(inner):
            own = members.pop(node, sample[:0])
            if not len(own):
                continue
            best = None
            for candidate in rng.choice(own, min(8, len(own)), replace=False):
                distance = np.bitwise_count(own ^ candidate).astype(np.int16)
                for median in {int(np.median(distance)), int(np.median(distance)) - 1}:
                    near = int((distance <= median).sum())
                    edge = int((abs(distance - median - 0.5) < 1).sum())
                    cost = max(near, len(own) - near) + edge / 2
                    if 0 < near < len(own) and (best is None or cost < best[0]):
                        best = cost, candidate, median, distance
            if best is None:  # all equal
                members[2 * node + 1] = own
                continue
            _, points[node], medians[node], distance = best
            members[2 * node + 1] = own[distance <= medians[node]]
            members[2 * node + 2] = own[distance > medians[node]]
        return cls(depth, points, medians)

    def leaves(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of a value, leaf): every leaf that can hold a value
        within the radius; with radius 0 the one leaf it falls into."""
        index, node = np.arange(len(values)), np.zeros(len(values), np.int64)
        for _ in range(self.depth):
            median = self.medians[node]
            distance = np.bitwise_count(values[index] ^ self.points[node]).astype(np.int16)
            left = (median < 0) | (distance - radius <= median)
            right = (median >= 0) & (distance + radius > median)
            index = np.concatenate((index[left], index[right]))
            node = np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
        return index, node - (2 ** self.depth - 1)


def _half(fp: np.ndarray, shift: int) -> np.ndarray:
    return (fp.view(np.uint64) >> np.uint64(shift)).astype(np.uint32)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) of the graph with edges a-b."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)  # the root's label, so whole trees move
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def linked_in_shard(stored: np.ndarray, asked: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between stored and asked fingerprints."""
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(stored), 1024):
        rows = stored[at:at + 1024].view(np.uint64)
        for to in range(0, len(asked), 2048):
            columns = asked[to:to + 2048]
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ columns.view(np.uint64)[None, :]) <= bits)
            a, b = stored[at + i], columns[j]
            apart = a != b
            if apart.any():
                ends.append(forest(a[apart], b[apart]))
    if not ends:
        return stored[:0], stored[:0]
    return forest(np.concatenate([x for x, _ in ends]), np.concatenate([y for _, y in ends]))


def links(
    distinct: DataFrame, bits: int = 3, leaf: int = 2000, sample_rows: int = 20_000, most_depth: int = 14,
) -> DataFrame:
    """Edges (a, b) that span every component of the fingerprints `fp`, which
    must be distinct, under links of at most `bits` differing bits.
    leaf: stored fingerprints a shard should have; sample_rows: how many the trees
    are fitted on."""
    count = distinct.count()
    depth = min(most_depth, max(0, int(np.ceil(np.log2(max(1, count / leaf))))))
    share = min(1.0, sample_rows / max(1, count))
    rows = (distinct.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
            .limit(2 * sample_rows).collect())  # a bounded sample
    sample = np.sort(np.array([r["fp"] for r in rows], np.int64))
    trees = [Tree.fit(_half(sample, s), depth) for s in HALVES]  # at most 2 ** most_depth nodes each
    radius = bits // 2

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = batch["fp"].to_numpy(np.int64)
            for at in range(0, len(every), 2048):
                fp = every[at:at + 2048]
                for number, (tree, shift) in enumerate(zip(trees, HALVES, strict=True)):
                    values = _half(fp, shift)
                    _, home = tree.leaves(values, 0)
                    index, leaves = tree.leaves(values, radius)
                    own = np.empty(len(fp), np.int64)
                    own[tree.leaves(values, 0)[0]] = home
                    yield pd.DataFrame({
                        "tree": np.full(len(index), number, np.int32), "leaf": leaves.astype(np.int32),
                        "fp": fp[index], "home": own[index] == leaves})

    placed = distinct.select("fp").mapInPandas(place, "tree int, leaf int, fp long, home boolean")
    sizes = placed.groupBy("tree", "leaf").agg(F.sum(F.col("home").cast("long")).alias("held"))
    # a row per leaf: at most 2 * 2 ** most_depth
    parts = F.broadcast(
        sizes.where("held > 0")
        .select("tree", "leaf", F.ceil(F.col("held") / (4 * leaf)).cast("int").alias("parts")))
    own_part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    shards = placed.join(parts, ["tree", "leaf"]).select(
        "tree", "leaf", "fp", "home", own_part.alias("own"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        fp = shard["fp"].to_numpy(np.int64)
        held = shard["home"].to_numpy(bool) & (shard["own"] == shard["part"]).to_numpy(bool)
        a, b = linked_in_shard(fp[held], fp, bits)
        return pd.DataFrame({"a": a, "b": b})

    return shards.groupBy("tree", "leaf", "part").applyInPandas(search, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (a, b): the least node reachable."""
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct())
    for _ in range(most_rounds):
        both = edges.unionAll(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("m"))
        near = near.select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours go to the least of the neighbourhood
        large = both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        # small star: smaller neighbours and the node itself go to the least one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        new = cut(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        # done when every node has one edge, and roots have none
        roots = new.groupBy("a").agg(F.count("*").alias("n"))
        star = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        if roots.where("n > 1").isEmpty() and star.isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = new
    raise RuntimeError("components did not settle")


def near_copies(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, key, fp, component_id for every row of docs."""
    own = cut(fingerprints(docs, shingle))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    found = components(links(distinct.select("fp"), bits))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", "key", "fp", "component_id")


def hex_digits(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def without_near_copies(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """docs with one row of each component."""
    return one_of_each(docs, near_copies(docs, shingle, bits))


def one_of_each(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """docs with one row of each component of copies (doc_id, key, fp, component_id): the one
    with the least id, and of the rows with this id the one with the least key; of equal
    rows one.  Columns stay as they are.  Only keys are shuffled unless very many rows go."""
    found = cut(copies.groupBy("component_id", "fp", "doc_id", "key").agg(F.count("*").alias("times")))
    # a component without any id is told by its fingerprint: its texts all have null ids
    component = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")))
    best = found.groupBy(component.alias("c")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("kept"))
    gone = small_side(found.select("key", component.alias("c")).join(best, "c")
                      .where(F.col("key") != F.col("kept")).select("key").distinct())
    again = small_side(found.where("times > 1").select("key").distinct())
    own = doc_key(docs["doc_id"], docs["text"])
    left = docs.join(gone, own == gone["key"], "left_anti")
    once = left.join(again, own == again["key"], "left_anti")
    first = (left.join(again, own == again["key"], "left_semi")
             .withColumn("key of row", own).dropDuplicates(["key of row"]).drop("key of row"))
    return once.unionAll(first)
