"""Contiguous shards of equal bytes, from prefix sums of sizes.

The rows are put in the order (doc_id, checksum, size) by a range partitioning.
Each partition has a total; the exclusive prefix sum of these totals, plus the
running sum inside the partition, is the global position of a row in bytes.
Cutting the byte axis at equal targets gives contiguous shards whose sizes
differ by less than two rows.

Only narrow rows are shuffled, never a text.  Equal rows are counted before the
range partitioning and spelled out after it, so copies of one row, however many,
don't meet in a task.  One row per partition is all that is gathered for the
prefix sum, and one per shard for the slots.

Edge cases: a null text has no bytes (size 1, checksum 0, as the empty one); null ids come
first; equal rows take adjacent slots; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import cut, slots


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")))


def _positions(docs: DataFrame) -> DataFrame:
    """A row per distinct (doc_id, text_crc32, size): copies, and where the
    first of them starts in bytes and in rows."""
    groups = (
        docs.select("doc_id", checksum(F.col("text")).alias("text_crc32"),
                    size_of(F.col("text")).alias("size"))
        .groupBy("doc_id", "text_crc32", "size").agg(F.count("*").alias("copies"))
    )
    groups = cut(
        groups.repartitionByRange(slots(docs), "doc_id", "text_crc32", "size")
        .withColumn("part", F.spark_partition_id())
    )
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        groups.groupBy("part")
        .agg(F.sum(F.col("size") * F.col("copies")).alias("part_bytes"),
             F.sum("copies").alias("part_rows"))
        .select("part",
                F.coalesce(F.sum("part_bytes").over(everything), F.lit(0)).alias("bytes_before"),
                F.coalesce(F.sum("part_rows").over(everything), F.lit(0)).alias("rows_before"),
                F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"))
    )
    inside = (
        Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # a row per partition: bounded by their number
    return (
        groups
        .withColumn("start", F.coalesce(
            F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
        .withColumn("row", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(F.broadcast(totals), "part")
        .withColumn("start", F.col("start") + F.col("bytes_before"))
        .withColumn("row", F.col("row") + F.col("rows_before"))
        .drop("part", "bytes_before", "rows_before")
    )


def _cut_at(start: Column, size: Column, total: Column, shards: int) -> Column:
    """The shard that holds the middle of the row."""
    middle = (start * 2 + size) * shards
    return F.floor((middle - middle % (total * 2)) / (total * 2)).cast("int")


def byte_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs."""
    rows = (
        _positions(docs)
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
        .withColumn("row", F.col("row") + F.col("copy"))
        .withColumn("shard", _cut_at(F.col("start"), F.col("size"), F.col("all_bytes"), shards))
    )
    first = rows.groupBy("shard").agg(F.min("row").alias("first_row"))
    # a row per shard
    return rows.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"),
    )


def _key(doc_id: Column, text_crc32: Column, size: Column) -> Column:
    """Orders as a range partitioning does: nulls first."""
    return F.struct(
        doc_id.isNotNull().alias("a"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("b"),
        text_crc32.alias("c"), size.alias("d"),
    )


def with_shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs with all its columns and the column shard.  The cuts are at most
    shards - 1 keys, so each row finds its shard by itself and no text moves.
    Equal rows share a shard; a column that was called shard is replaced."""
    groups = _positions(docs).withColumn(
        "shard", _cut_at(F.col("start"), F.col("size"), F.col("all_bytes"), shards)
    )
    key = _key(F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    cuts = groups.groupBy("shard").agg(F.min(key).alias("k")).orderBy("shard").collect()
    own = _key(docs["doc_id"], checksum(docs["text"]), size_of(docs["text"]))
    shard = F.lit(0)
    for shard_no, k in ((r["shard"], r["k"]) for r in cuts):
        least = F.struct(*(
            F.lit(v).cast(t).alias(n)
            for n, v, t in zip("abcd", k, ("boolean", "long", "long", "long"), strict=True)
        ))
        shard = F.when(own >= least, F.lit(shard_no)).otherwise(shard)
    return docs.withColumn("shard", shard.cast("int"))
