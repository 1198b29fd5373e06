"""Structured Streaming forms of the live rules.

Each function maps a streaming DataFrame to a streaming DataFrame; ``drain``
runs one to the end of its available input and returns what it wrote.
"""

from __future__ import annotations

import threading
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from tidegauge.operators.bars import moment
from tidegauge.session import checkpoint_root


def read_files(spark: SparkSession, path: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    """Files of a table as a stream; ``path`` is its folder, or the file of a table of one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    reader = spark.readStream.schema(schema).option("pathGlobFilter", where.getName() if one else "*.parquet")
    path = where.getParent().toString() if one else path
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def closed_bars(ticks: DataFrame, seconds: int, delay: str) -> DataFrame:
    """Bars emitted once their window is closed by the watermark; the open one never appears."""
    w, order = F.window("ts", f"{seconds} seconds"), moment()
    out = ticks.withWatermark("ts", delay).groupBy("symbol", w.alias("w")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"),
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def complete_bars(bars: DataFrame, step: int, seconds: int, delay: str) -> DataFrame:
    """Coarser bars from a bar stream; buckets without every slot are dropped."""
    w = F.window("ts", f"{seconds} seconds")
    slot = (F.unix_seconds("ts") % seconds / step).cast("int")
    out = bars.withWatermark("ts", delay).groupBy("symbol", w.alias("w")).agg(
        F.min_by("open", F.col("ts")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.col("ts")).alias("close"),
        F.sum("volume").alias("volume"),
        F.size(F.collect_set(slot)).alias("slots"),
    )
    return out.filter(F.col("slots") == seconds // step).select(
        "symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume"
    )


def sliding_imbalance(ticks: DataFrame, width: str, slide: str, delay: str) -> DataFrame:
    """Signed over total notional per sliding window."""
    sign = F.when(F.col("buyer_maker"), -1.0).otherwise(1.0)
    value = F.col("qty") * F.col("price")
    out = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width, slide).alias("w")).agg(
        F.sum(sign * value).alias("signed"), F.sum(value).alias("vol")
    )
    return out.select("symbol", F.col("w.end").alias("ts"), F.try_divide("signed", "vol").alias("imbalance"))


def first_copies(rows: DataFrame, key: list[str], delay: str) -> DataFrame:
    """Keep one row per key while copies arrive within the delay."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def append_log(records: DataFrame, path: str, checkpoint: str):
    """Decision records appended as JSON lines, exactly once per checkpoint."""
    return (
        records.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


class Progress(StreamingQueryListener):
    """Rows read and late rows dropped by each run of a query, over all of its batches."""

    def __init__(self):
        self.rows, self.late, self.ended = Counter(), Counter(), threading.Condition()
        self.over: set[str] = set()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        run = str(event.progress.runId)
        self.rows[run] += event.progress.numInputRows
        self.late[run] += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryTerminated(self, event):
        with self.ended:
            self.over.add(str(event.runId))
            self.ended.notify_all()


def drain(stream: DataFrame, name: str, mode: str = "append", root: str | None = None) -> tuple[DataFrame, dict]:
    """Run to the end of the input into a parquet table; also its row counts.

    A second call with the same ``root`` goes on where the first ended.
    """
    spark = stream.sparkSession
    root = root or f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    seen = Progress()
    spark.streams.addListener(seen)
    try:
        q = (
            stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
            .outputMode(mode).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        run = str(q.runId)
        with seen.ended:  # events come in order, so the counts are whole once the end is reported
            if not seen.ended.wait_for(lambda: run in seen.over, timeout=60):
                raise TimeoutError(f"no end reported for stream {name}")
    finally:
        spark.streams.removeListener(seen)
    return spark.read.schema(stream.schema).parquet(f"{root}/out"), {"input_rows": seen.rows[run], "dropped_late": seen.late[run]}
