"""What several operators of this package share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what separates words, and what a word is
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# rows up to which a table with rows of bounded width is broadcast
BROADCAST_ROWS = 100_000


def cut(df: DataFrame) -> DataFrame:
    """Compute a table once and cut its lineage with a reliable checkpoint in
    the folder of spark.checkpoint.dir: a lost executor loses none of it.
    Only a session that names no folder (tests) gets one of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="palisade-llm-"))
    return df.checkpoint()


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table computed once, with a broadcast hint only if it was counted
    to have few rows; a longer one is joined by a shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def doc_key(doc_id: Column, text: Column) -> Column:
    """Names a document together with its text, so that rows which repeat an
    id with another text stay apart.  Equal rows share it."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")), text.isNull())


def slots(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
