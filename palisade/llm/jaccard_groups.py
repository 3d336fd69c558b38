"""Join of texts by the Jaccard similarity of their word shingles, with a token-group matrix.

A text's set is its distinct shingles.  Two sets that are similar enough share a number of the tokens
that come first in each under any common order; the order here puts frequent tokens last (by a
sketch of token counts over all documents), so what comes first is rare.  Sets that share too few of
their first tokens with others link with nothing and leave.  The rest is partitioned into groups of similar
sets: each goes to the one of its first tokens that most sets share.  The token-group matrix says which groups
hold a token.

Inside a group sets are compared by the postings of the group's tokens.  Between groups the matrix
bounds the overlap twice: a set is sent to a group only if the group holds enough of its first tokens
(in members whose size allows the similarity); there its overlap with the union of all the group's tokens
is counted, and the group is opened only if that reaches the threshold.  The groups to look up are found by the
rarest of the first tokens alone, by exact counts: of k shared ones, s of which a partner must have, by k - s + 1.

What is wanted are the classes that the links connect, so sets that are known to be connected needn't
meet: after the groups' own links, and those of the set with the most links in each group that had to be
split, only tokens whose holders are still in several classes and groups are followed, and only by the sets
outside the largest of these classes.  A group of near copies so costs a bounded number of comparisons a set, in
parts of a bounded number of tokens, however large it is; no link between classes is lost.

Equal sets are one row throughout.  A set is known by 128 bits of hash; shingles are compared by 64.

Edge cases: fewer words than a shingle are one shingle of all of them; texts without words (null, empty,
blank) have an empty set and are a class each; rows with a null id join classes, whose id is the least
of the ids that are there (null if there are none); repeated rows give a row each; a very long text is one
set; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import small_side
from palisade.llm.simhash import SEED, components, forest
from palisade.plans.storage import stored

SHINGLE, LEAST_PCT = 3, 90
SHARED, MORE = 8, 32  # two similar sets of n tokens and more share SHARED + n // MORE first tokens
PART = 1 << 18  # tokens that a task compares at once, but for one longer set
SKETCH_BITS, CHUNKS = 22, 64
MOST_BITS = 27  # of the bitmap of tokens that occur again
ROUNDS = 3  # in which sets with too few shared tokens leave
_A, _B, _C, _D, _E = (np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


class _Hashes(dict):
    """Hashes of words, a bounded number of them remembered."""

    def __missing__(self, word: bytes) -> int:
        own = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= 64 and len(self) < 500_000:
            self[word] = own
        return own


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _D
    x = (x ^ (x >> np.uint64(29))) * _E
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, known: dict, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the distinct shingles of a text, sorted."""
    # bytes.lower changes A-Z only, bytes.split takes \\x20 and \\x09-\\x0D
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    length = min(shingle, len(h))
    n = len(h) - length + 1
    total = np.full(n, length, np.uint64)
    for k in range(length):
        total = _mixed(total * _A + h[k:k + n] * _B + np.uint64(k) * _C)
    return np.unique(total)


def need(n: int, least_pct: int = LEAST_PCT) -> int:
    """Tokens that a set of n must share with any that is similar to it."""
    return -(-least_pct * n // 100)


def least_different(least_pct: int = LEAST_PCT) -> int:
    """The size from which a set can be similar to a different one: one token more, and SHARED in common."""
    n = 1
    while 100 * n < least_pct * (n + 1) or need(n, least_pct) < SHARED + n // MORE:
        n += 1
    return n


def shared_first(n: Column, least_pct: int) -> Column:
    """First tokens that a set of n shares with any that is similar: the smaller of the two may have fewer."""
    return F.lit(SHARED) + F.floor(F.ceil(n * least_pct / 100) / MORE)


# ---- passes over the texts

def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes of both that name equal rows."""
    doc_id, text = docs["doc_id"], docs["text"].cast("string")
    return docs.select(
        doc_id.cast("long").cast("string").alias("doc_id"),  # keeps nulls whole in pandas
        text.alias("text"), F.xxhash64(doc_id, text, text.isNull()).alias("k1"),
        F.xxhash64(F.lit(SEED), text, doc_id).alias("k2"))


def _counted(tokens: list[np.ndarray]) -> np.ndarray:
    first = np.concatenate([np.zeros(0, np.uint64), *tokens]) >> np.uint64(64 - SKETCH_BITS)
    return np.bincount(first.astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)


def _identified(narrow: DataFrame, shingle: int) -> DataFrame:
    """A row per document: doc_id, k1, k2, n, f1, f2 (the set's 128 bits); and with chunk and counts
    set, what a task counted of the tokens, by their first bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts, tokens, pending = _Hashes(), np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
        for batch in batches:
            sizes, marks = [], []
            for text in batch["text"]:
                own = shingle_set(text, known, shingle)
                sizes.append(len(own))
                marks.append(xxhash.xxh3_128_intdigest(own.tobytes(), SEED))
                tokens.append(own)
                pending += len(own)
                if pending > 1 << 20:  # bounded memory
                    counts += _counted(tokens)
                    tokens, pending = [], 0
            low = (1 << 64) - 1
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "k1": batch["k1"], "k2": batch["k2"], "n": np.array(sizes, np.int64),
                "f1": np.array([m >> 64 for m in marks], np.uint64).view(np.int64),
                "f2": np.array([m & low for m in marks], np.uint64).view(np.int64), "chunk": -1, "counts": None})
        counts += _counted(tokens)
        if counts.any():
            yield pd.DataFrame({
                "doc_id": None, "k1": 0, "k2": 0, "n": 0, "f1": 0, "f2": 0, "chunk": np.arange(CHUNKS),
                "counts": [zlib.compress(c.tobytes(), 1) for c in np.split(counts, CHUNKS)]})

    return narrow.select("doc_id", "text", "k1", "k2").mapInPandas(
        run, "doc_id string, k1 long, k2 long, n long, f1 long, f2 long, chunk int, counts binary")


def _levels(parts: DataFrame) -> np.ndarray:
    """The binary logarithm of the number of tokens with the same first bits."""
    size = (1 << SKETCH_BITS) // CHUNKS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch["chunk"], batch["counts"], strict=True):
                own = np.frombuffer(zlib.decompress(counts), np.uint32)
                total[chunk] = total.get(chunk, np.zeros(size, np.int64)) + own
        if total:
            yield pd.DataFrame({"chunk": list(total), "level": [
                np.log2(1 + c).astype(np.uint8).tobytes() for c in total.values()]})

    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    # a row per chunk, a byte per counter
    for r in parts.select("chunk", "counts").repartition(CHUNKS, "chunk").mapInPandas(
            run, "chunk int, level binary").collect():
        out[r["chunk"] * size:(r["chunk"] + 1) * size] = np.frombuffer(bytes(r["level"]), np.uint8)
    return out


def _first_tokens(narrow: DataFrame, levels: np.ndarray, shingle: int, least_pct: int) -> DataFrame:
    """token, f1, f2, n: the first tokens of every set that can be similar to a different one."""
    smallest = least_different(least_pct)
    shared = narrow.sparkSession.sparkContext.broadcast(levels)  # 2 ** SKETCH_BITS bytes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, levels, done = _Hashes(), shared.value, set()
        for batch in batches:
            frames = [[np.zeros(0, np.int64)] for _ in range(4)]
            for text in batch["text"]:
                own = shingle_set(text, known, shingle)
                mark = xxhash.xxh3_128_intdigest(own.tobytes(), SEED)
                if len(own) < smallest or mark in done:
                    continue
                if len(done) < 500_000:
                    done.add(mark)
                level = levels[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                # stable: the tokens of a level keep their order
                first = np.argsort(level, kind="stable")[:len(own) - need(len(own), least_pct) + SHARED + len(own) // MORE]
                f1, f2 = np.array([mark >> 64, mark & ((1 << 64) - 1)], np.uint64).view(np.int64)
                for frame, column in zip(frames, (
                        own[first].view(np.int64), np.full(len(first), f1), np.full(len(first), f2),
                        np.full(len(first), len(own))), strict=True):
                    frame.append(column)
            yield pd.DataFrame({c: np.concatenate(f) for c, f in zip(("token", "f1", "f2", "n"), frames, strict=True)})

    return narrow.select("text").mapInPandas(run, "token long, f1 long, f2 long, n long")


def _bitmap(tokens: DataFrame, bits: int) -> np.ndarray:
    """The bits of some tokens, built on Spark in blocks; 2 ** bits of them at most come here."""
    at = F.col("token").bitwiseAND(F.lit((1 << bits) - 1))
    rows = tokens.groupBy(F.shiftright(at, 15).alias("block")).agg(
        F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << 15) - 1))).alias("own")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[r["block"] * 4096:(r["block"] + 1) * 4096] = np.frombuffer(bytes(r["own"]), np.uint8)
    return out


def _pruned(first: DataFrame, least_pct: int) -> DataFrame:
    """The rows of first whose token other rows have too, of sets that keep enough of them; and a few more:
    tokens that share a bit with such ones, and the sets at the edges of a task, whose rows it may not have all.
    The rows of a set stand together, so only counts of tokens are shuffled."""
    shared = stored(first.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token"))
    bits = min(MOST_BITS, max(16, int(64 * shared.count()).bit_length()))
    bitmap = first.sparkSession.sparkContext.broadcast(_bitmap(shared, bits))  # MOST_BITS bound it

    def able(rows: pd.DataFrame, edge: bool) -> pd.DataFrame:
        """Without the sets that have too few rows; edge: the first one may have more in another task."""
        mark = rows["f1"].to_numpy(), rows["f2"].to_numpy()
        begins = np.flatnonzero(np.concatenate(([True], (mark[0][1:] != mark[0][:-1]) | (mark[1][1:] != mark[1][:-1]))))
        size = np.diff(np.append(begins, len(rows)))
        n = rows["n"].to_numpy()[begins]
        keep = size >= SHARED + -(-least_pct * n // 100) // MORE
        keep[0] |= edge
        return rows[np.repeat(keep, size)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, start = None, True
        for batch in batches:
            at = batch["token"].to_numpy(np.int64) & ((1 << bits) - 1)
            rows = batch[(bitmap.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            rows = rows if rest is None else pd.concat([rest, rows])
            if not len(rows):
                continue
            # the set that may go on stays behind
            f1, f2 = rows["f1"].to_numpy(), rows["f2"].to_numpy()
            going = (f1 == f1[-1]) & (f2 == f2[-1])
            going[:len(going) - np.argmin(going[::-1])] = going.all()
            rest, done = rows[going], rows[~going]
            if len(done):
                yield able(done, start)
                start = False
        if rest is not None and len(rest):
            yield rest

    return first.mapInPandas(run, first.schema)


def _sets(narrow: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """f1, f2, tokens (8 bytes each, sorted) of the documents k1, k2 of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            yield pd.DataFrame({"f1": batch["f1"], "f2": batch["f2"], "tokens": [
                shingle_set(x, known, shingle).tobytes() for x in batch["text"]]})

    texts = narrow.join(rows, ["k1", "k2"]).select("f1", "f2", "text")
    return texts.mapInPandas(run, "f1 long, f2 long, tokens binary").groupBy("f1", "f2").agg(
        F.first("tokens").alias("tokens"))


# ---- one group

class Group:
    """Sets with the postings of their tokens."""

    def __init__(self, sets: list[np.ndarray], least_pct: int = LEAST_PCT):
        self.least_pct, self.sizes = least_pct, np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        self.union, at = np.unique(every, return_inverse=True)
        self.members = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(at, kind="stable")]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(self.union)))))

    def linked(self, own: np.ndarray) -> np.ndarray:
        """The members that are similar to a set."""
        at = np.searchsorted(self.union, own)
        at = at[at < len(self.union)]
        hits = at[self.union[at] == own[:len(at)]]
        if not len(own) or len(hits) < need(len(own), self.least_pct):
            return np.zeros(0, np.int64)  # the union bounds the overlap: not opened
        lengths = self.starts[hits + 1] - self.starts[hits]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1]) + np.repeat(self.starts[hits] - ends + lengths, lengths)
        both = np.bincount(self.members[places], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= self.least_pct * (len(own) + self.sizes - both))


def _bytes(rows: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in rows]


def _own_links(rows: pd.DataFrame, least_pct: int) -> tuple[list, list, int, int]:
    """A spanning forest of the links in a group (as row numbers), the row with most links, their number."""
    sets = _bytes(rows["tokens"])
    group = Group(sets, least_pct)
    a, b, most, hub = [], [], -1, 0
    pending = 0
    for i, own in enumerate(sets):
        near = group.linked(own)
        if len(near) > most:
            most, hub = len(near), i
        near = near[near < i]
        a.append(np.full(len(near), i)), b.append(near)
        pending += len(near)
        if pending > 1 << 20:  # bounded memory
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, pending = [x], [y], len(x)
    x, y = forest(np.concatenate(a), np.concatenate(b))
    return x, y, hub, most


# ---- the join

def _id() -> Column:
    return F.concat(F.lpad(F.hex("f1"), 16, "0"), F.lpad(F.hex("f2"), 16, "0"))



def _parts(of: str, part: int) -> Column:
    return F.ceil(F.col(of) / F.lit(part)).cast("int")


def _buckets(df: DataFrame, tokens: str, part: int) -> int:
    """Into how many tasks' worth the tokens of a table go."""
    return 1 + 2 * int(df.agg(F.sum(tokens)).first()[0] or 0) // part


def _inside(members: DataFrame, sets: DataFrame, part: int, least_pct: int) -> DataFrame:
    """Edges a, b between members of a group; with b null: the set with most links of a part, and how many."""
    n = _buckets(members, "n", part)
    shared = small_side(members.groupBy("ord", "part").agg(F.count("*").alias("m")).where("m > 1").drop("m"))
    rows = members.join(shared, ["ord", "part"]).join(sets, ["f1", "f2"]).select(
        "ord", "part", _id().alias("id"), "tokens", F.pmod(F.xxhash64("ord", "part"), F.lit(n)).alias("bucket"))

    def search(bucket: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for (place, number), own in bucket.groupby(["ord", "part"]):
            ids = own["id"].to_numpy()
            a, b, hub, most = _own_links(own, least_pct)
            frames.append((np.append(ids[a], ids[hub]), np.append(ids[b], None), np.full(len(a) + 1, place), np.full(len(a) + 1, most)))
        return pd.DataFrame({name: pd.Series(np.concatenate(column), dtype=kind) for name, column, kind in zip(
            ("a", "b", "ord", "most"), zip(*frames, strict=True), (object, object, "int64", "int64"), strict=True)})

    return rows.groupBy("bucket").applyInPandas(search, "a string, b string, ord long, most long")


def _between(asked: DataFrame, members: DataFrame, sets: DataFrame, part: int, least_pct: int) -> DataFrame:
    """Edges between the asked sets (f1, f2, n, label, ord, part: the group they are sent to) and the
    members of the groups (f1, f2, n, label, ord, part) that have another label."""
    slices = small_side(asked.groupBy("ord", "part").agg(F.sum("n").alias("asked")).select(
        "ord", "part", _parts("asked", part).alias("slices")))
    asked = asked.join(slices, ["ord", "part"]).withColumn("slice", F.pmod(F.xxhash64("f1", "f2"), "slices").cast("int"))
    held = members.join(slices, ["ord", "part"]).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    sides = asked.select("f1", "f2", "n", "label", "ord", "part", "slice", F.lit(True).alias("asked")).unionAll(
        held.select("f1", "f2", "n", "label", "ord", "part", "slice", F.lit(False).alias("asked")))
    sides = stored(sides)
    bucket = F.pmod(F.xxhash64("ord", "part", "slice"), F.lit(_buckets(sides, "n", part))).alias("bucket")
    rows = sides.join(sets, ["f1", "f2"]).select(
        _id().alias("id"), "label", "ord", "part", "slice", "asked", "tokens", bucket)

    def search(bucket: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, own in bucket.groupby(["ord", "part", "slice"]):
            here, there = own[~own["asked"]], own[own["asked"]]
            if not len(here) or not len(there):
                continue
            group = Group(_bytes(here["tokens"]), least_pct)
            ids, labels = here["id"].to_numpy(), here["label"].to_numpy()
            for ident, label, tokens in zip(there["id"], there["label"], _bytes(there["tokens"]), strict=True):
                near = group.linked(tokens)
                near = near[labels[near] != label]
                _, one = np.unique(labels[near].astype(str), return_index=True)  # one link a class
                a += [ident] * len(one)
                b += ids[near[one]].tolist()
        return pd.DataFrame({"a": a, "b": b}, dtype=object)

    return rows.groupBy("bucket").applyInPandas(search, "a string, b string")


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with the label of their class."""
    found = components(edges)
    return members.join(found, members["id"] == found["node"], "left").select(
        *members.columns, F.coalesce("root", "id").alias("label"))


def _to_ask(matrix: DataFrame, members: DataFrame, least_pct: int) -> DataFrame:
    """The sets and the other groups they must be sent to: f1, f2, n, label, ord, part (of the group)."""
    own = ["f1", "f2", "n", "label", "home", "at"]
    held = matrix.select("token", "f1", "f2").join(members.select(
        "f1", "f2", "n", "label", F.col("ord").alias("home"), F.col("part").alias("at")), ["f1", "f2"])
    enough = shared_first(F.col("n"), least_pct)
    for _ in range(2):  # sets that still have enough tokens whose holders are in several classes and groups
        several = held.groupBy("token").agg(
            F.min("label").alias("a"), F.max("label").alias("b"), F.min(F.struct("home", "at")).alias("c"),
            F.max(F.struct("home", "at")).alias("d"), F.count("*").alias("df")).where("a != b and c != d")
        held = held.drop("df").join(several.select("token", "df"), "token")
        able = held.groupBy("f1", "f2").agg(F.count("*").alias("k"), F.first("n").alias("n")).where(
            F.col("k") >= enough).select("f1", "f2", "k")
        held = stored(held.drop("k").join(able, ["f1", "f2"]))
    rarest = Window.partitionBy("f1", "f2").orderBy("df", "token")
    first = stored(held.withColumn("nr", F.row_number().over(rarest)).where(
        F.col("nr") <= F.col("k") - enough + 1).drop("nr"))
    classes = first.groupBy("token", "label").agg(F.count("*").alias("m"))
    largest = classes.groupBy("token").agg(
        F.max(F.struct("m", "label"))["label"].alias("most"), F.count("*").alias("c")).where("c > 1").select("token", "most")
    followed = first.join(largest, "token")
    groups = followed.select("token", F.col("home").alias("ord"), F.col("at").alias("part")).distinct()
    pairs = followed.where("label != most").select("token", *own).join(groups, "token").where(
        "ord != home or part != at").select(*own, "ord", "part").distinct()
    # the matrix: which groups hold a token, in members of which classes and sizes
    entries = held.groupBy("token", F.col("home").alias("ord"), F.col("at").alias("part")).agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    return pairs.join(held.select("f1", "f2", "token"), ["f1", "f2"]).join(entries, ["token", "ord", "part"]).where(
        ((F.col("low") != F.col("label")) | (F.col("high") != F.col("label")))
        & (F.col("least") * least_pct <= F.col("n") * 100) & (F.col("most") * 100 >= F.col("n") * least_pct)
    ).groupBy("f1", "f2", "n", "label", "ord", "part").agg(F.count("*").alias("m")).where(
        F.col("m") >= enough).drop("m")


def linked_sets(narrow: DataFrame, own: DataFrame, levels: np.ndarray, shingle: int, least_pct: int, part: int) -> DataFrame:
    """f1, f2, label (of the class) of the sets that share enough first tokens with others."""
    matrix = stored(_first_tokens(narrow, levels, shingle, least_pct))
    for _ in range(ROUNDS):
        matrix = stored(_pruned(matrix, least_pct))
    matrix = stored(matrix.distinct())
    # groups, split where they hold too many tokens for a task
    sizes = matrix.groupBy("token").agg(F.count("*").alias("df"))
    sets = matrix.join(sizes, "token").groupBy("f1", "f2", "n").agg(
        F.max(F.struct("df", "token"))["token"].alias("ord"))
    heavy = small_side(sets.groupBy("ord").agg(F.sum("n").alias("tokens"), F.count("*").alias("m"))
                       .where((F.col("tokens") > part) & (F.col("m") > 1)).select("ord", _parts("tokens", part).alias("parts")))
    members = stored(sets.join(heavy, "ord", "left").select(
        "f1", "f2", "n", "ord", F.coalesce(F.pmod(F.xxhash64("f1", "f2"), "parts").cast("int"), F.lit(0)).alias("part"),
        F.col("parts").isNotNull().alias("split"), _id().alias("id")))
    rows = own.join(members.select("f1", "f2"), ["f1", "f2"]).groupBy("f1", "f2").agg(
        F.min(F.struct("k1", "k2")).alias("k")).select("f1", "f2", "k.k1", "k.k2")
    tokens = stored(_sets(narrow, small_side(rows), shingle))
    placed = matrix.select("token", "f1", "f2", "n").join(members.select("f1", "f2", "ord", "part"), ["f1", "f2"])
    twice = placed.groupBy("ord", "part", "token").agg(F.count("*").alias("m")).where("m > 1").select("ord", "part", "token")
    close = placed.join(twice, ["ord", "part", "token"]).groupBy("ord", "part", "f1", "f2", "n").agg(F.count("*").alias("m")).where(
        F.col("m") >= shared_first(F.col("n"), least_pct)).select("ord", "part", "f1", "f2", "n")
    found = stored(_inside(stored(close), tokens, part, least_pct))
    edges = found.where("b is not null").select("a", "b")
    # of a split group, the set with the most links meets all parts
    hubs = (found.where("b is null").join(small_side(members.where("split").select("ord").distinct()), "ord")
            .groupBy("ord").agg(F.max(F.struct("most", "a"))["a"].alias("id")))
    split = members.where("split")
    asked = hubs.join(members.select("id", "f1", "f2", "n"), "id").join(
        split.select("ord", "part").distinct(), "ord").select("f1", "f2", "n", F.col("id").alias("label"), "ord", "part")
    edges = stored(edges.unionAll(_between(
        asked, split.select("f1", "f2", "n", F.col("id").alias("label"), "ord", "part"), tokens, part, least_pct)))
    members = stored(_labelled(members, edges))
    asked = _to_ask(matrix, members, least_pct)
    more = _between(stored(asked), members, tokens, part, least_pct)
    return _labelled(members.drop("label"), stored(edges.unionAll(more))).select("f1", "f2", "label")


def classes(docs: DataFrame, shingle: int = SHINGLE, least_pct: int = LEAST_PCT, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    narrow = _narrow(docs)
    both = stored(_identified(narrow, shingle))
    own = both.where("chunk < 0").select(F.col("doc_id").cast("long").alias("doc_id"), "k1", "k2", "n", "f1", "f2")
    levels = _levels(both.where("chunk >= 0"))
    labels = stored(linked_sets(narrow, own.where("n > 0"), levels, shingle, least_pct, part))
    # a set that met no other is a class of its own
    sets = own.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("least"))
    sets = sets.join(labels, ["f1", "f2"], "left").select("f1", "f2", "least", F.coalesce("label", _id()).alias("label"))
    sets = stored(sets)
    ids = sets.groupBy("label").agg(F.min("least").alias("component_id"))
    known = sets.join(ids, "label").select("f1", "f2", "component_id")
    full = own.where("n > 0").join(known, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionAll(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
