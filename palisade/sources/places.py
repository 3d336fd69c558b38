"""Lines of text files with their place in the file, whatever the reader's splits are.

A split tells its start, and its lines come in order.  One pass sums the bytes (and quotes, and
records) of every split; sums over the splits of a file, a row per split, give what lies before each.  A
second pass adds what lies before a line inside its split, by cumulative sums over Arrow batches.  So no text is
shuffled, and a place stays the same under any split size and any set of files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.plans.storage import stored

FEW_SPLITS = 100_000
QUOTE = '"'


def _split_lines(spark: SparkSession, paths, sep: str) -> DataFrame:
    return spark.read.option("lineSep", sep).text(paths).select(
        "value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], slice]]:
    """The runs of rows of one split in a batch."""
    source = pc.dictionary_encode(batch.column("source"))
    code, block = source.indices.to_numpy(), batch.column("block").to_numpy()
    ends = [*(np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1), len(code)]
    start = 0
    for end in ends:
        if end > start:
            yield (source.dictionary[int(code[start])].as_py(), int(block[start])), slice(start, end)
        start = end


def _measured(batch: pa.RecordBatch, sep_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with the line end, quotes, and whether there is any text, of every line."""
    value = batch.column("value")
    size = pc.binary_length(value).to_numpy(zero_copy_only=False).astype(np.int64)
    quotes = pc.count_substring(value, QUOTE).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.greater(pc.binary_length(pc.utf8_rtrim(value, "\r")), 0).to_numpy(zero_copy_only=False)
    return size + sep_bytes, quotes, filled


def placed_lines(spark: SparkSession, paths, sep: str = "\n") -> DataFrame:
    """value, source, block, offset (bytes before the line in its file), quotes (quotation marks
    before it), records (records with text that begin before it, a record being what stands between line ends
    outside of quotation marks)."""
    step = len(sep.encode())
    lines = _split_lines(spark, paths, sep)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            size, quotes, filled = _measured(batch, step)
            for key, rows in _pieces(batch):
                own = sums.setdefault(key, np.zeros(4, np.int64))
                even = (own[1] + np.cumsum(quotes[rows]) - quotes[rows]) % 2 == 0
                own += (size[rows].sum(), quotes[rows].sum(), (even & filled[rows]).sum(), (~even & filled[rows]).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()),
             *[pa.array([int(s[i]) for s in sums.values()], pa.int64()) for i in range(4)]],
            names=["source", "block", "bytes", "marks", "if_even", "if_odd"])

    totals = lines.mapInArrow(total, "source string, block long, bytes long, marks long, if_even long, if_odd long")
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row per split
    zero = F.lit(0).cast("bigint")
    # stored, as the count and the second pass read it: the totals are a pass over all text
    starts = stored(totals.withColumn("quotes_at", F.coalesce(F.sum("marks").over(before), zero)).withColumn(
        "begun", F.when(F.col("quotes_at") % 2 == 0, F.col("if_even")).otherwise(F.col("if_odd"))).select(
        "source", "block", "quotes_at", F.coalesce(F.sum("bytes").over(before), zero).alias("bytes_at"),
        F.coalesce(F.sum("begun").over(before), zero).alias("records_at")))
    if starts.limit(FEW_SPLITS + 1).count() <= FEW_SPLITS:
        starts = F.broadcast(starts)  # counted

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, None
        for batch in batches:
            size, quotes, filled = _measured(batch, step)
            out = [np.zeros(len(size), np.int64) for _ in range(3)]
            base = [batch.column(c).to_numpy() for c in ("bytes_at", "quotes_at", "records_at")]
            for key, rows in _pieces(batch):
                if key != last:
                    last, at = key, [int(b[rows.start]) for b in base]
                marks = at[1] + np.cumsum(quotes[rows]) - quotes[rows]
                begun = ((marks % 2 == 0) & filled[rows]).astype(np.int64)
                for to, what, was in ((0, size[rows], at[0]), (2, begun, at[2])):
                    out[to][rows] = was + np.cumsum(what) - what
                out[1][rows] = marks
                at = [at[0] + int(size[rows].sum()), at[1] + int(quotes[rows].sum()), at[2] + int(begun.sum())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("value"), batch.column("source"), batch.column("block"), *map(pa.array, out)],
                names=["value", "source", "block", "offset", "quotes", "records"])

    return lines.join(starts, ["source", "block"]).select(
        "value", "source", "block", "bytes_at", "quotes_at", "records_at").mapInArrow(
        place, "value string, source string, block long, offset long, quotes long, records long")


def place_id(source: Column, offset: Column) -> Column:
    """The event id of a place: a range of its own for each file, from a hash of its path, in the
    order of the file.  (10 000 files of 1 GB overlap with probability 0.02; source and offset tell them apart.)"""
    return F.xxhash64(source).bitwiseAND(F.lit((1 << 62) - 1)) + offset


def records(placed: DataFrame) -> DataFrame:
    """source, offset, number (of records before it), text: lines joined where a line end stands inside
    quotation marks.  Only lines of such records are shuffled, and no file is one task: what begins
    the record of a line is sought in its split, then among one row per split."""
    line = F.rtrim(F.col("value"), F.lit("\r"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit(QUOTE)))) % 2 == 1
    begins = F.col("quotes") % 2 == 0
    rows = placed.select("source", "block", "offset", "records", line.alias("line"), begins.alias("begins"), odd.alias("odd"))
    single = rows.filter("begins and not odd and line != ''").select(
        "source", "offset", F.col("records").alias("number"), F.col("line").alias("text"))
    split = rows.filter("not begins or odd").withColumn("begin", F.when(F.col("begins"), F.struct("offset", "records")))
    inside = W.partitionBy("source", "block").orderBy("offset")
    carried = split.groupBy("source", "block").agg(F.max("begin").alias("last")).select(
        "source", "block", F.max("last").over(
            W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    found = split.withColumn("own", F.max("begin").over(inside)).join(carried, ["source", "block"]).withColumn(
        "start", F.coalesce("own", "carried"))
    whole = found.groupBy("source", "start").agg(
        F.array_sort(F.collect_list(F.struct("offset", "line"))).alias("lines"))
    return single.unionByName(whole.select(
        "source", F.col("start.offset").alias("offset"), F.col("start.records").alias("number"),
        F.array_join("lines.line", "\n").alias("text")))
