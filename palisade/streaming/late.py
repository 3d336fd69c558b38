"""Nothing of a stream is lost: rows in time, late rows, rows without a time.

A stateful step drops rows that are late by the watermark of the batch before: the latest time of
the batches before that one, less the delay.  It is known when a batch begins, so the same comparison,
made in foreachBatch, says which rows the step will drop, and keeps them aside.  (A step that has
idle time runs batches without data; these move its watermark on, and it drops a little more.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.schema import micros

IN_TIME, LATE, UNTIMED = "in_time", "late", "untimed"
MILLI, SECOND = 1_000, 1_000_000


class Arrivals:
    """A stream written to `folder` as three parts of a table, by the column `arrival`.

    delay_sec: that of the watermark of the step to come.  window_sec, step_sec: its windows; a row is late
    when the last window it lies in has ended.  Without windows it is late when its own time has passed."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, delay_sec: int,
                 window_sec: int = 0, step_sec: int | None = None):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.delay, self.window = delay_sec * SECOND, window_sec * SECOND
        self.step = (step_sec or window_sec or 1) * SECOND

    def _ends(self) -> Column:
        t = micros(F.col("ts"))
        return t - F.pmod(t, F.lit(self.step)) + self.window if self.window else t

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def watermark(self, number: int) -> int | None:
        """By which watermark rows of a batch are late, in microseconds; whole milliseconds, as the engine counts."""
        if number < 2:
            return None
        marks = self._table("marks", T.StructType([
            T.StructField("latest", T.LongType()), T.StructField("batch", T.LongType())]))
        latest = marks.filter(F.col("batch") < number - 1).agg(F.max("latest")).first()[0]
        return None if latest is None else latest // MILLI * MILLI - self.delay

    def advance(self, batch: DataFrame, number: int) -> None:
        """Store one batch; a second try of it overwrites the first."""
        mark = self.watermark(number)
        late = F.lit(False) if mark is None else self._ends() <= mark
        arrival = F.when(F.col("ts").isNull(), UNTIMED).when(late, LATE).otherwise(IN_TIME)
        batch.select(*self.schema.names).withColumn("arrival", arrival).write.mode("overwrite").partitionBy(
            "arrival").parquet(f"{self.folder}/rows/batch={number}")
        own = self.rows().filter(F.col("batch") == number)
        own.agg(F.max(micros(F.col("ts"))).alias("latest")).write.mode("overwrite").parquet(
            f"{self.folder}/marks/batch={number}")

    def run(self, events: DataFrame, **trigger) -> None:
        """Take in a stream, by default all there is."""
        events.writeStream.foreachBatch(self.advance).option(
            "checkpointLocation", f"{self.folder}/state").trigger(
            **(trigger or {"availableNow": True})).start().awaitTermination()

    def rows(self) -> DataFrame:
        """All rows so far, with `batch` and `arrival`."""
        return self._table("rows", T.StructType([*self.schema.fields, T.StructField("batch", T.LongType()),
                                                 T.StructField("arrival", T.StringType())]))

    def part(self, arrival: str) -> DataFrame:
        """The rows in time, the late ones or those without a time."""
        return self.rows().filter(F.col("arrival") == arrival).select(*self.schema.names)
