"""Polling loops as Structured Streaming: file source, dedup state, daily windows, resumable month sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.sources.shared import deleted, shared_path


def events_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """The event files as a stream; times become timestamps with a zone (UTC), which watermarks need."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{glob}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, n, mean_value in tumbling days."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.to_date("window.start").alias("day"), "event_type", "n", "mean_value")


def first_seen(stream: DataFrame, key: str, late: str | None = None) -> DataFrame:
    """One row a key: for ever, or as long as the watermark keeps state."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if late else stream.dropDuplicates([key])


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """All that is there now, then stop; a later run goes on where this one ended."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q


def run_every(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], interval: str = "30 minutes", mode: str = "append") -> StreamingQuery:
    """A batch at each interval; end it with the query's stop()."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(sink).start()


def month_sink(path: str, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """Writes a batch below month=YYYY-MM/batch=N, over what an earlier try of the same batch left there."""

    def write(df: DataFrame, batch: int) -> None:
        out = df.withColumns({"month": F.date_format(ts, "yyyy-MM"), "batch": F.lit(batch)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(path)

    return write


def missing_months(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Months of the span that have no partition below path yet."""
    from brindle.functions.dates import months

    done = spark.read.parquet(path).select("month").distinct()
    return months(spark, first, last).select(F.date_format("month", "yyyy-MM").alias("month")).join(done, "month", "left_anti")


def stream_result(spark: SparkSession, stream: DataFrame, schema, mode: str) -> DataFrame:
    """The rows of a stream run to its end, from the files its batches wrote; in complete mode the last batch's."""
    out, last = f"{shared_path(spark)}-stream", []

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        last.append(batch)

    run_once(stream, f"{out}-checkpoint", sink, mode)
    deleted(spark, f"{out}-checkpoint")
    if not last:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema)
    return rows.parquet(f"{out}/batch={max(last)}") if mode == "complete" else rows.parquet(*[f"{out}/batch={b}" for b in sorted(set(last))])
