"""Structured Streaming forms of ingestion, aggregation and publishing.

Row-ordered readers (first-wins dedup, carry-forward) need batch windows, so they run
inside ``foreachBatch`` on whole immutable files. Every sink writes a folder named after
the query and the batch: a replay after failure overwrites itself, and another query on the
same target, whose batches count from 0 too, overwrites nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemeter.functions import calendar as cal
from tidemeter.functions import labels
from tidemeter.functions.volumes import zero
from tidemeter.plans.mart import UsageMart
from tidemeter.plans.tiers import TieredMart
from tidemeter.sources import logs

# Fixed value: default refresh interval.
REFRESH = "300 seconds"


def table_stream(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """A stored table as a stream, be it one Parquet file or a folder of part files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    reader = spark.readStream.schema(schema)
    return reader.parquet(str(path)) if status.isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)


def closed(stream: DataFrame, folder: str) -> DataFrame:
    """The stream with an end-of-input marker: a row of a far time, kept in ``folder``, that moves the watermark
    past all windows, so that the last ones come out too. Its own window stays open and never comes out."""
    spark = stream.sparkSession
    fields = [F.lit("9999-01-01" if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*fields).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def log_stream(
    spark: SparkSession, path: str, source: str, pattern: str | None = None,
    max_file_bytes: int | None = None, files_per_batch: int = 1000, bundled: bool = False,
) -> DataFrame:
    """Lines (or whole files) with their lineage; land logs as immutable chunks.

    Bundles come as they are, for a batch to open with ``logs.unbundle``; all lines of a log must lie in one of them.
    """
    guard = logs.MAX_FILE_BYTES if source == "gemini" and max_file_bytes is None else max_file_bytes
    scan = (
        spark.readStream.format("text")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern or (logs.BUNDLES if bundled else logs.GLOBS[source]))
        .option("wholetext", str(source == "gemini" and not bundled).lower())
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
        .select(F.when(logs.fits(F.col("_metadata.file_size"), None if bundled else guard), F.col("value")).alias("value"),
                F.col("_metadata.file_path").alias("file_path"),
                F.col("_metadata.file_block_start").alias("block"))
    )
    if source == "gemini" and pattern is None and not bundled:
        scan = scan.where(F.col("file_path").rlike(r"/chats/[^/]+$"))
    return scan


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a started query keeps in its checkpoint for life."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def start(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str,
    interval: str | None = None, mode: str = "append",
) -> StreamingQuery:
    """Run ``each`` per micro-batch, on an interval or once over what is available."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def _opened(batch: DataFrame, source: str, max_file_bytes: int | None) -> DataFrame:
    """The lines of a batch of bundles; those of logs beyond the guard are null."""
    lines = logs.unbundle(batch)
    guard = logs.MAX_FILE_BYTES if source == "gemini" and max_file_bytes is None else max_file_bytes
    if guard is None:
        return lines
    size = F.octet_length("value")
    if source != "gemini":
        size = F.sum(size.cast("bigint") + 1).over(W.partitionBy("file_path"))
    return lines.withColumn("_size", size).withColumn("value", F.when(F.col("_size") <= guard, F.col("value"))).drop("_size")


def ingest_logs(
    spark: SparkSession, path: str, source: str, zone: str, target: str, checkpoint: str,
    pattern: str | None = None, interval: str | None = None, rejects: str | None = None,
    max_file_bytes: int | None = None, max_line_chars: int | None = None, bundled: bool = False,
) -> StreamingQuery:
    """Parse newly landed files into ``target/source=../batch=..``, and what they do not yield, with its
    reason, into ``rejects`` (by default beside the target)."""
    rejects = rejects or f"{target.rstrip('/')}-rejects"

    def each(batch: DataFrame, batch_id: int) -> None:
        name = f"source={source}/batch={query_id(spark, checkpoint)}-{batch_id}"
        lines = (_opened(batch, source, max_file_bytes) if bundled else logs.number_lines(batch)).persist()
        try:
            oversize = lines.where("value is null").select(
                F.lit(source).alias("source"), F.lit("file_too_large").alias("reason"), "file_path", "block", "seq")
            found = logs.classify(lines.where("value is not null"), source, zone, max_line_chars)
            good = logs.first_messages(found) if source == "claude" else found.where("reason is null").drop("reason")
            good.drop("source").write.mode("overwrite").parquet(f"{target}/{name}")
            logs.rejects(found).unionByName(oversize.distinct()).drop("source").write.mode("overwrite").parquet(f"{rejects}/{name}")
        finally:
            lines.unpersist()

    return start(log_stream(spark, path, source, pattern, max_file_bytes, bundled=bundled), each, checkpoint, interval)


def maintain(
    stream: DataFrame, mart: UsageMart, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Merge each micro-batch of records into the mart and publish when content changed; failures are kept
    in the mart's ``failures()``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        mart.add_batch(batch, f"{query_id(stream.sparkSession, checkpoint)}-{batch_id}")
        mart.try_publish(mart.hours)

    return start(stream, each, checkpoint, interval)


def maintain_tiers(
    stream: DataFrame, mart: TieredMart, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """As ``maintain``, with work per batch that does not grow with the history. A publication that fails raises, and
    the batch is repeated: its rows are not added twice, and the months that it touched are still marked."""
    def each(batch: DataFrame, batch_id: int) -> None:
        mart.add_batch(batch, query_id(stream.sparkSession, checkpoint), batch_id)
        mart.publish()

    return start(stream, each, checkpoint, interval)


def tumbling_totals(stream: DataFrame, width: str, delay: str = "1 day", zone: str | None = None, untimed: bool = False) -> DataFrame:
    """Totals per event-time window and model; week and month roll up from days.

    ``untimed`` counts records without a time at the start of their day, as the batch day totals do;
    it is for windows of whole days.

    Windows follow the wall clock of ``zone`` (the session's by default), so that a day
    window is a calendar day of the report. Watermarks need instants and windows count in
    UTC, so the wall clock is carried as if it were UTC and read back the same way.
    """
    return window_totals(timed_rows(stream, delay, zone, untimed), width)


def timed_rows(stream: DataFrame, delay: str, zone: str | None = None, untimed: bool = False) -> DataFrame:
    """The rows of a stream with their wall clock as ``at``, watermarked; rows without a time are left out."""
    wall = cal.wall_clock(F.col("ts"), zone) if zone else F.col("ts").cast("timestamp_ntz")
    if untimed:
        wall = F.coalesce(wall, F.col("day").cast("timestamp_ntz"))
    return stream.withColumn("at", cal.as_utc(wall)).where("at is not null").withWatermark("at", delay)


def window_totals(timed: DataFrame, width: str) -> DataFrame:
    return timed.groupBy(
        F.window("at", width).alias("w"), labels.model_or_unknown(F.col("model")).alias("model")
    ).agg(F.sum(zero(F.col("total"))).alias("total"), F.count(F.lit(1)).alias("calls")).select(
        cal.wall_clock(F.col("w.start"), "UTC").alias("start"), "model", "total", "calls")


def unique_messages(stream: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """First arrival per key within the watermark, with bounded state; records without a time count at the
    start of their day. ``late.unique_messages`` also keeps what comes too late."""
    return first_arrivals(dated(stream, delay), keys)


def dated(stream: DataFrame, delay: str) -> DataFrame:
    at = F.coalesce(F.col("ts"), F.col("day").cast("timestamp"))
    return stream.withColumn("_at", at).withWatermark("_at", delay)


def first_arrivals(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.dropDuplicatesWithinWatermark(keys).drop("_at")


def activity_sessions(stream: DataFrame, keys: list[str], gap: str, delay: str) -> DataFrame:
    """Runs of activity separated by at least ``gap``, emitted once closed."""
    timed = stream.where("ts is not null").withWatermark("ts", delay)
    return timed.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum(zero(F.col("total"))).alias("total"), F.count(F.lit(1)).alias("calls")).drop("w")


def season_sessions(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Seasons on a stream: month plus a session window over days.

    Session windows merge when they touch, so a gap of seven and a half days splits days
    that are eight apart and keeps days that are seven apart. Records without a time count on their day.
    """
    day = F.coalesce(F.date_trunc("day", F.col("ts")), F.col("day").cast("timestamp"))
    daily = stream.withColumn("at", day).where("at is not null").withWatermark("at", delay)
    return daily.groupBy(
        F.date_format("at", "yyyy-MM").alias("month"), F.session_window("at", "7 days 12 hours").alias("w")
    ).agg(F.min("at").alias("start"), F.max("at").alias("end"), F.sum(zero(F.col("total"))).alias("total")).drop("w")


#: Column of a batch's own time in an update-mode sink.
STAMP = "_batch_ms"


def write_updates(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Update-mode sink: changed groups per batch, under the query and the batch that changed them."""
    from tidemeter.streaming.late import batch_metadata

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = stream.sparkSession
        stamp = batch_metadata(spark, checkpoint, batch_id)["batchTimestampMs"]
        batch.withColumn(STAMP, F.lit(stamp)).write.mode("overwrite").parquet(f"{path}/batch={query_id(spark, checkpoint)}-{batch_id}")

    return start(stream, each, checkpoint, interval, mode="update")


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Latest value of each group of an update-mode sink, by the time of its batch."""
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(STAMP), F.desc("batch")))
    return spark.read.parquet(path).withColumn("_r", newest).where("_r = 1").drop("_r", "batch", STAMP)


def write_rows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-mode Parquet sink over what is available now."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
