"""Late rows kept: a stateful stream and, beside its result, every row that it was too late for.

A stateful operator drops rows at or below the query's watermark without a trace. Here the same query also passes
its input through, in a second branch, and each micro-batch sorts that branch by the watermark that its own
operators used. That watermark stands in the query's offset log, written before the batch runs, so a batch that is
replayed after a failure finds the same one and sorts the same rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemeter.plans.files import Files
from tidemeter.streaming import live


def batch_metadata(spark: SparkSession, checkpoint: str, batch_id: int) -> dict:
    """What the offset log says of a batch: ``batchWatermarkMs``, ``batchTimestampMs``."""
    return json.loads(Files(spark, checkpoint).read(f"{checkpoint}/offsets/{batch_id}").splitlines()[1])


def late_before(spark: SparkSession, checkpoint: str, batch_id: int) -> int:
    """Milliseconds at or below which a batch's operators drop rows: the watermark of the batch before it."""
    return batch_metadata(spark, checkpoint, batch_id - 1)["batchWatermarkMs"] if batch_id else 0


def start_with_late(
    rows: DataFrame, result: DataFrame, due: Column, target: str, late: str, checkpoint: str,
    mode: str = "append", interval: str | None = None,
) -> StreamingQuery:
    """Write ``result``, a stateful stream over ``rows``, to ``target``, and to ``late`` the rows it dropped.

    ``due`` is the instant that decides about a row: it is late from the batch on whose operators see a watermark
    of that instant. A folder is named after query and batch in both targets, so a replay overwrites itself.
    """
    spark = rows.sparkSession
    kept, row = F.struct(*result.columns), F.struct(*rows.columns)
    both = result.select(
        kept.alias("kept"), F.lit(None).cast(rows.schema).alias("row"), F.lit(None).cast("timestamp").alias("due")
    ).unionByName(rows.select(F.lit(None).cast(result.schema).alias("kept"), row.alias("row"), due.cast("timestamp").alias("due")))

    def each(batch: DataFrame, batch_id: int) -> None:
        name = f"batch={live.query_id(spark, checkpoint)}-{batch_id}"
        stamp = batch_metadata(spark, checkpoint, batch_id)["batchTimestampMs"]
        floor = late_before(spark, checkpoint, batch_id)
        batch = batch.persist()  # computed once: its operators write state
        try:
            batch.where("kept is not null").select("kept.*", F.lit(stamp).alias(live.STAMP)).write.mode("overwrite").parquet(f"{target}/{name}")
            dropped = batch.where(F.col("row").isNotNull() & (F.unix_micros("due") <= F.lit(floor) * 1000))
            dropped.select("row.*").write.mode("overwrite").parquet(f"{late}/{name}")
        finally:
            batch.unpersist()

    return live.start(both, each, checkpoint, interval, mode)


def tumbling_totals(
    stream: DataFrame, width: str, target: str, late: str, checkpoint: str, delay: str = "1 day",
    zone: str | None = None, untimed: bool = False, interval: str | None = None,
) -> StreamingQuery:
    """``live.tumbling_totals`` as updates in ``target`` (see ``live.read_updates``); a row whose window had closed
    goes to ``late``. Both together count every row of the stream that has a time (with ``untimed``, or a day)."""
    rows = live.timed_rows(stream, delay, zone, untimed)
    closes = rows.withColumn("_w", F.window("at", width)).withColumn("_due", F.col("_w.end")).drop("_w")
    return start_with_late(closes, live.window_totals(rows, width), F.col("_due"), target, late, checkpoint, "update", interval)


def unique_messages(
    stream: DataFrame, keys: list[str], target: str, late: str, checkpoint: str, delay: str = "1 day", interval: str | None = None,
) -> StreamingQuery:
    """``live.unique_messages`` in ``target``; a row too late to be told from a repetition goes to ``late``, repeated
    or not."""
    rows = live.dated(stream, delay)
    return start_with_late(rows, live.first_arrivals(rows, keys), F.col("_at"), target, late, checkpoint, "append", interval)
