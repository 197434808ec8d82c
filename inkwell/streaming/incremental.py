"""Incremental processing: a file stream whose keys are taken once, one atomic append for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources import checkpoint


def process_new(spark: SparkSession, source: str, schema: str, key: str, transform: Callable[[DataFrame], DataFrame], out: str, out_schema: str, state: str) -> int:
    """Take up all files that are new, skip keys that are done, append the rest. A batch that fails is taken up again;
    keys that a replayed batch had written already are skipped, so each key is there once. Returns the batches run."""

    def batch(df: DataFrame, _: int) -> None:
        fresh = checkpoint.resume(df.dropDuplicates([key]), out, key, out_schema)
        checkpoint.append(transform(fresh), out)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and kind. On a stream rows later than the watermark are left out."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, width).alias("_w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("_w.start").alias("window_start"), kind, "n", "total")
