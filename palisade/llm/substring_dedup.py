"""Passages that repeat across documents, found with Aho-Corasick automata.

A window is `length` consecutive words.  A word goes if a window over it also starts in a
document with a smaller id.

1. Anchors.  The anchor of a window is the least hash among its 5-word sequences, so equal windows
   have equal anchors, and neighbouring windows mostly share one.  Per document the distinct
   anchors (about a fifth of its words) are counted by partial sums: an anchor of two or more
   documents may be of a repeated window, any other can't.
2. Stretches.  A second pass cuts every document into the stretches of windows with such an anchor.
   The anchors reach the tasks as a bitmap whose size is bounded; beyond the bound
   they are joined instead.  Equal stretches are combined before they meet.
3. Automata.  Stretches are dealt into shards by anchor.  In a shard, windows of two or more documents
   are confirmed word by word and compiled into an automaton over words, which then reads all
   stretches of the shard and reports every occurrence with the least document id of its window.  Where an
   anchor is of very many documents, its stretches are single windows, combined by their own text.
4. Removal.  Occurrences go back to their documents; a bitmap of the documents that lose words spares
   the shuffle of the other texts.

Edge cases: null texts and texts shorter than a window lose nothing; a row with a null id loses nothing
and takes nothing from others; rows that repeat an id are one document; an empty table gives an empty
result; other columns are ignored.  Long texts are hashed in pieces.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import cut, doc_key, slots
from palisade.plans.storage import shared_folder

GRAM = 5
MOST_BITS = 29  # of a bitmap that is sent to all tasks: 64 MB
PIECE = 8192  # windows hashed at a time
LONGEST_STRETCH = 64  # windows
WIDE = 50_000  # documents of an anchor beyond which its windows are dealt one by one
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Anchors:
    """Anchors of the windows of a text, as 64-bit hashes."""

    def __init__(self, length: int):
        self.length = length
        self.gram = min(GRAM, length)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _tables(self, size: int) -> None:
        if len(self.power) < size:
            size = max(size, 1 << 16)
            for name, base in (("power", BASE), ("inverse", INVERSE)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table))

    def piece(self, parts: list[bytes]) -> np.ndarray:
        """The anchor of every window of these words."""
        raw = np.frombuffer(b" ".join(parts), np.uint8)
        self._tables(len(raw) + 1)
        stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], stops[:-1] + 1))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[:len(raw)], out=sums[1:])
        first = starts[:len(parts) - self.gram + 1]
        h = (sums[stops[self.gram - 1:]] - sums[first]) * self.inverse[first]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        need, span = self.length - self.gram + 1, 1
        while span < need:  # running minimum by doubling
            step = min(span, need - span)
            h = np.minimum(h[:-step], h[step:])
            span += step
        return h

    def pieces(self, parts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first window, anchors) for stretches of windows."""
        for at in range(0, len(parts) - self.length + 1, PIECE):
            yield at, self.piece(parts[at:at + PIECE + self.length - 1])


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _narrow(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").cast("string").alias("doc_id"),  # nulls stay whole in pandas
        doc_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("string").alias("text"), *more)


def document_anchors(docs: DataFrame, length: int) -> DataFrame:
    """anchor, doc_id, key: the distinct anchors of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = Anchors(length)
        for batch in batches:
            found, owners, size = [], [], 0
            for row, text in enumerate(batch["text"]):
                own = [np.unique(h) for _, h in anchors.pieces(_split(text))]
                if own:
                    found.append(own[0] if len(own) == 1 else np.unique(np.concatenate(own)))
                    owners.append(np.full(len(found[-1]), row))
                    size += len(found[-1])
                if found and (size > 200_000 or row == len(batch) - 1):
                    at = np.concatenate(owners)
                    yield pd.DataFrame({
                        "anchor": np.concatenate(found).view(np.int64),
                        "doc_id": batch["doc_id"].to_numpy().astype(np.int64)[at], "key": batch["key"].to_numpy()[at]})
                    found, owners, size = [], [], 0
            if found:
                at = np.concatenate(owners)
                yield pd.DataFrame({
                    "anchor": np.concatenate(found).view(np.int64),
                    "doc_id": batch["doc_id"].to_numpy().astype(np.int64)[at], "key": batch["key"].to_numpy()[at]})

    return _narrow(docs.where("doc_id is not null and text is not null")).mapInPandas(
        run, "anchor long, doc_id long, key long")


def _bits_for(count: int) -> int:
    """Logarithm of the size of a bitmap with few false hits for so many values."""
    return max(16, int(np.ceil(np.log2(max(1, count) * 16))))


# a value sets two bits, named by its own bits from these on; two probes let through far fewer others than one
PROBES = (0, 30)


def _in_bitmap(bitmap: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    found = np.ones(len(values), bool)
    for shift in PROBES:
        slot = (values >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        found &= (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def _bitmap(recurring: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits bits of the column anchor, gathered as packed segments."""
    segment = min(bits, 19)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << segment, np.uint8)
        own[rows["slot"].to_numpy() & ((1 << segment) - 1)] = 1
        return pd.DataFrame({"segment": rows["segment"][:1], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    slots_of = F.array(*(F.shiftrightunsigned("anchor", x).bitwiseAND((1 << bits) - 1) for x in PROBES))
    rows = (recurring.select(F.explode(slots_of).alias("slot")).select("slot", F.shiftright("slot", segment).alias("segment"))
            .groupBy("segment").applyInPandas(pack, "segment long, bits binary").toPandas())
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for number, packed in zip(rows["segment"], rows["bits"], strict=True):
        at = int(number) << segment >> 3
        whole[at:at + (1 << segment >> 3)] = np.frombuffer(packed, np.uint8)
    return whole


def stretches(
    docs: DataFrame, length: int, most_bits: int = MOST_BITS, most_wide: int = 50_000,
) -> tuple[DataFrame, int]:
    """doc_id, key, n_words, digest, found: the stretches (start, anchor or 0, id, words) of
    every row of docs; and how many anchors recur."""
    every = document_anchors(docs, length)
    counted = every.groupBy("anchor").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    recurring = cut(counted.where("least < most").select("anchor", "n"))
    sums = recurring.agg(F.count("*").alias("anchors"), F.sum("n").alias("rows")).first()
    count, rows = sums["anchors"], sums["rows"] or 0
    # anchors of so many documents that their stretches are dealt by text: at most most_wide
    many = max(WIDE, rows // most_wide)
    wide = np.sort(np.array([r["anchor"] for r in recurring.where(F.col("n") > many).select("anchor").collect()], np.int64))
    bits = _bits_for(count)
    session = docs.sparkSession.sparkContext
    if bits <= most_bits:
        shared = session.broadcast((_bitmap(recurring, bits), bits))
        rows_in = _narrow(docs, F.lit(None).cast("array<long>").alias("own"))
    else:
        shared = session.broadcast((None, 0))
        own = every.join(recurring.select("anchor"), "anchor").groupBy(F.col("key").alias("k")).agg(
            F.collect_set("anchor").alias("own"))  # bounded by the length of the text
        rows_in = _narrow(docs).join(own, F.col("key") == F.col("k"), "left").drop("k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = Anchors(length)
        bitmap, bits = shared.value
        for batch in batches:
            out = []
            for doc_id, key, text, own in zip(*(batch[c] for c in ("doc_id", "key", "text", "own")), strict=True):
                parts = _split(text)
                found = []
                for at, h in anchors.pieces(parts) if doc_id is not None else ():
                    if bitmap is not None:
                        may = _in_bitmap(bitmap, bits, h)
                    else:
                        may = np.isin(h.view(np.int64), np.asarray([] if own is None else own, np.int64))
                    if not may.any():
                        continue
                    new = np.concatenate(([True], h[1:] != h[:-1]))
                    first = np.flatnonzero(new)
                    last = np.concatenate((first[1:], [len(h)]))
                    keep = may[first]
                    dense = np.isin(h[first].view(np.int64), wide)
                    for i, j, one in zip(first[keep].tolist(), last[keep].tolist(), dense[keep].tolist(), strict=True):
                        step = 1 if one else LONGEST_STRETCH
                        for start in range(i, j, step):
                            words = b" ".join(parts[at + start:at + min(j, start + step) + length - 1])
                            found.append({
                                "start": at + start, "anchor": 0 if one else int(h[i].view(np.int64)),
                                "id": xxhash.xxh64_intdigest(words) - (1 << 63),
                                "words": words.decode("utf-8", "surrogatepass")})
                whole = b" ".join(parts)
                out.append((doc_id, key, len(parts), hashlib.sha256(whole).hexdigest(), found))
                if len(out) >= 500:
                    yield pd.DataFrame(out, columns=["doc_id", "key", "n_words", "digest", "found"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "key", "n_words", "digest", "found"])

    schema = ("doc_id string, key long, n_words long, digest string, "
              "found array<struct<start:int,anchor:long,id:long,words:string>>")
    path = f"{shared_folder(docs.sparkSession).rstrip('/')}/stretches-{uuid.uuid4().hex}"
    rows_in.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long")).write.option(
        "compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path), count


class Symbols:
    """Words as three characters each, the first from a range of its own, so automata have
    narrow nodes and can't match across words."""

    def __init__(self) -> None:
        self.numbers: dict[str, str] = {}

    def _new(self, word: str) -> str:
        n = len(self.numbers)
        code = chr(0x4000 + n % 256) + chr(0x1000 + n // 256 % 256) + chr(0x1000 + n // 65536)
        self.numbers[word] = code
        return code

    def coded(self, words: str) -> str:
        known = self.numbers
        return "".join([known.get(w) or self._new(w) for w in words.split(" ")])


def occurrences(shard: pd.DataFrame, length: int) -> pd.DataFrame:
    """Rows id, words, least, most of a shard -> id and, for each window of the stretch, the
    least document id if the window is of several documents, else null."""
    symbols, size = Symbols(), 3 * length
    read = [symbols.coded(words) for words in shard["words"]]
    least_of, most_of = {}, {}
    for words, least, most in zip(read, shard["least"].tolist(), shard["most"].tolist(), strict=True):
        for i in range(0, len(words) - size + 1, 3):
            window = words[i:i + size]
            if least < least_of.get(window, least + 1):
                least_of[window] = least
            if most > most_of.get(window, most - 1):
                most_of[window] = most
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for window, least in least_of.items():
        if least < most_of[window]:
            automaton.add_word(window, least)
    if not len(automaton):
        return pd.DataFrame({"id": [], "firsts": []})
    automaton.make_automaton()
    ids, firsts = [], []
    for own, words in zip(shard["id"].tolist(), read, strict=True):
        found: list[int | None] = [None] * (len(words) // 3 - length + 1)
        for end, least in automaton.iter(words):
            found[(end + 1 - size) // 3] = least
        if any(x is not None for x in found):
            ids.append(own)
            firsts.append(found)
    return pd.DataFrame({"id": ids, "firsts": firsts})


def repeated_starts(table: DataFrame, anchors: int, length: int, per_shard: int = 4_000) -> DataFrame:
    """key, starts: the windows of a document that also start in an earlier one."""
    rows = table.select("doc_id", "key", F.explode("found").alias("f")).select("doc_id", "key", "f.*")
    shards = max(slots(table), -(-anchors // per_shard))
    ends = F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    # an anchor has at most WIDE documents here, so its stretches go to their shard as they are
    dealt = rows.where("anchor != 0").select(
        F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "id", "words", "doc_id")
    found = (
        dealt.repartition(slots(table), "shard").groupBy("shard", "id", "words").agg(*ends)
        .groupBy("shard").applyInPandas(lambda shard: occurrences(shard, length), "id long, firsts array<long>")
    )
    # windows of anchors with more documents are summed up one by one, on the map side first
    single = (rows.where("anchor = 0").groupBy("id", "words").agg(*ends).where("least < most")
              .select("id", F.array("least").alias("firsts")))
    found = found.unionAll(single)
    earlier = F.filter(
        F.transform("firsts", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    return (
        rows.select("id", "doc_id", "key", "start").join(found, "id")
        .select("key", earlier.alias("starts")).where("size(starts) > 0")
        .groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    )


def _may_change(docs: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, key, text of the documents that lose words, and of few others: a bitmap of
    their keys spares the shuffle of the other texts.  A fuller bitmap spares less."""
    keys = starts.select(F.col("key").alias("anchor"))
    bits = min(MOST_BITS, _bits_for(keys.count()))
    shared = docs.sparkSession.sparkContext.broadcast((_bitmap(keys, bits), bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            may = _in_bitmap(*shared.value, batch["key"].to_numpy(np.int64).view(np.uint64))
            if may.any():  # a frame without rows has no column types
                yield batch[may]

    return _narrow(docs).mapInPandas(run, "doc_id string, key long, text string")


def without_repeats(docs: DataFrame, length: int = 13, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if texts, kept_text (words joined by
    one space) for every row of docs."""
    table, anchors = stretches(docs, length)
    starts = cut(repeated_starts(table, anchors, length))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, starts in zip(batch["doc_id"], batch["text"], batch["starts"], strict=True):
                parts = _split(text)
                if starts is not None and len(starts):
                    step = np.zeros(len(parts) + 1, np.int64)
                    own = np.unique(np.asarray(starts, np.int64))
                    step[own] += 1
                    step[own + length] -= 1
                    stay = np.cumsum(step[:-1]) == 0
                    kept = list(compress(parts, stay.tolist()))
                else:
                    kept = parts
                joined = b" ".join(kept)
                out.append((doc_id, len(parts), len(parts) - len(kept), hashlib.sha256(joined).hexdigest(),
                            joined.decode("utf-8", "surrogatepass") if texts else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    schema = "doc_id string, n_words long, n_removed long, kept_sha256 string, kept_text string"
    if texts:
        whole = _narrow(docs).join(starts, "key", "left").select("doc_id", "text", "starts").mapInPandas(run, schema)
    else:
        changed = _may_change(docs, starts).join(starts, "key").select("doc_id", "text", "starts")
        same = table.join(starts.select("key"), "key", "left_anti").select(
            F.col("doc_id").cast("string").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"),
            F.col("digest").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
        whole = changed.mapInPandas(run, schema).unionAll(same)
    whole = whole.withColumn("doc_id", F.col("doc_id").cast("long"))
    return whole if texts else whole.drop("kept_text")
