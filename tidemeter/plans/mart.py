"""Incrementally maintained usage tables under one shared root.

Three kinds of state, all plain Parquet:

* ``hours`` / ``projects`` / ``sessions``: additive partial aggregates, one folder per
  batch. A replayed batch overwrites its own folder, so retries never double count, and
  late rows simply add to their day.
* ``records`` partitioned by day, for inputs whose files may grow or vanish: a refresh
  rewrites only the days it touches.
* ``published``: immutable versions plus a pointer table. The pointer row is written
  last, so a failed refresh leaves the previous version in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import date

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemeter.functions import calendar as cal
from tidemeter.operators.cube import COVERAGE, usage_cube
from tidemeter.operators.entities import entity_cube
from tidemeter.operators.registry import folded_cube
from tidemeter.operators.snapshot import snapshot_id
from tidemeter.plans.files import Files
from tidemeter.schema import COUNTERS, PARTS, RECORD
from tidemeter.sources import logs, manifest
from tidemeter.sources.sinks import nested_periods

_MANIFEST = "source string, file_path string, modified timestamp, bytes bigint, rules string, reader int, days array<date>"
_POINTER = "version bigint, snapshot_id string, first_day string, last_day string"
_SUMS = ("calls", *COUNTERS, *PARTS, *COVERAGE)


def table_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that may not exist yet. The schema is fixed, so nothing is inferred."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


_FAILURE = "version long, error string, message string"


class UsageMart:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def _path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def add_batch(self, rec: DataFrame, batch_id: int | str) -> None:
        """Write one batch's partial aggregates; safe to repeat with the same id."""
        rec = rec.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name, frame in (
                ("hours", usage_cube(rec)),
                ("projects", entity_cube(rec, "project")),
                ("sessions", entity_cube(rec, "session")),
            ):
                frame.write.mode("overwrite").parquet(self._path(name, f"batch={batch_id}"))
        finally:
            rec.unpersist()

    def hours(self) -> DataFrame:
        """The hour cube over all batches."""
        partial = self.spark.read.parquet(self._path("hours"))
        return partial.groupBy("day", "hour", "source", "model").agg(
            *[F.sum(c).alias(c) for c in _SUMS],
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))

    def entities(self, kind: str) -> DataFrame:
        """(day, entity, model) totals over all batches; ``kind`` is project or session."""
        return self.spark.read.parquet(self._path(f"{kind}s")).groupBy("day", "entity", "model").agg(
            F.sum("total").alias("total"), F.sum("calls").alias("calls"), F.min("first_day").alias("first_day"))

    def versions(self) -> DataFrame:
        return table_or_empty(self.spark, self._path("published", "pointers"), _POINTER)

    def latest(self) -> tuple[int, str | None]:
        row = self.versions().orderBy(F.desc("version")).limit(1).collect()
        return (row[0]["version"], row[0]["snapshot_id"]) if row else (0, None)

    def publish(self, cube: DataFrame) -> bool:
        """Write a new version when the content differs from the current one."""
        cube = cube.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            version, current = self.latest()
            found = snapshot_id(cube).collect()[0]
            if found["snapshot_id"] == current:
                return False
            nested_periods(folded_cube(cube)).write.mode("overwrite").parquet(
                self._path("published", "data", f"version={version + 1}"))
            self.spark.createDataFrame(
                [(version + 1, found["snapshot_id"], found["first_day"], found["last_day"])], _POINTER
            ).coalesce(1).write.mode("append").parquet(self._path("published", "pointers"))
            return True
        finally:
            cube.unpersist()

    def try_publish(self, build: Callable[[], DataFrame]) -> str:
        """Refresh that keeps the last good version: published, unchanged or failed."""
        try:
            return "published" if self.publish(build()) else "unchanged"
        except Exception as error:  # noqa: BLE001 - any failure must leave readers on the old version
            version, _ = self.latest()
            self.spark.createDataFrame([(version, type(error).__name__, str(error)[:500])], _FAILURE).withColumn(
                "at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self._path("published", "failures"))
            return f"failed: {type(error).__name__}"

    def failures(self) -> DataFrame:
        """Refreshes that left the version as it was, and why."""
        return table_or_empty(self.spark, self._path("published", "failures"), f"{_FAILURE}, at timestamp")

    def current(self) -> DataFrame:
        version, _ = self.latest()
        return self.spark.read.parquet(self._path("published", "data", f"version={version}"))

    def records(self, days: list[date] | None = None) -> DataFrame:
        """All records, or those of the given days, of which only the partitions are listed and read."""
        rows = table_or_empty(self.spark, self._path("records"), T.StructType([*RECORD.fields, T.StructField("p", T.StringType())]))
        if days is not None:
            rows = rows.where(F.col("p").isin([d.isoformat() for d in days]))
        return rows.select(*[f.name for f in RECORD])

    def index(self) -> DataFrame:
        """Every file of the last refresh with how it was read and the days it has rows on."""
        return table_or_empty(self.spark, self._path("manifest"), _MANIFEST)

    def refresh_files(
        self, current: DataFrame, read: Callable[[str, DataFrame | None, str | None], DataFrame],
        rules: Iterable[tuple[int, str, str]] = (), reader: int = logs.READER_VERSION,
    ) -> int:
        """Bring ``records`` in line with the files that exist now.

        Only files that are new, changed, or were read under other ``rules`` or by another ``reader`` version are
        parsed, and only days with changes are read and rewritten: the manifest knows the days of every file, so
        the rest of the record store is not even listed. ``read`` takes (source, files, after): the files to keep
        and a UTC time before which none of them was modified, both None on a first load. To the driver come one
        count and time per source, and the touched days. Returns the files parsed.

        Working tables lie under ``staging`` and go when the refresh ends. The manifest is written last: after a
        failure the next refresh finds the old one and repeats the work.
        """
        stage = self._path("staging", uuid.uuid4().hex[:12])

        def staged(frame: DataFrame, name: str) -> DataFrame:
            frame.write.parquet(f"{stage}/{name}")
            return self.spark.read.schema(frame.schema).parquet(f"{stage}/{name}")

        try:
            current = staged(manifest.read_by(current, rules, reader), "current")
            previous = self.index()
            fresh = staged(manifest.changed(current, previous, [*manifest.SIGNATURE, *manifest.READ_BY]), "fresh")
            gone = manifest.removed(current, previous)
            todo = fresh.groupBy("source").agg(
                F.count(F.lit(1)).alias("files"),
                F.date_format(
                    cal.wall_clock(F.min("modified"), "UTC") - F.expr("interval 1 second"), "yyyy-MM-dd'T'HH:mm:ss"
                ).alias("after")).collect()
            first = previous.isEmpty()
            parsed = self.spark.createDataFrame([], RECORD)
            for row in todo:
                mine = fresh.where(F.col("source") == row["source"])
                rows = read(row["source"], None if first else mine, None if first else row["after"])
                parsed = parsed.unionByName(rows, allowMissingColumns=True)
            parsed = staged(parsed.select(*[f.name for f in RECORD]), "parsed")
            touched = fresh.select(*manifest.KEYS).unionByName(gone.select(*manifest.KEYS)).distinct()
            before = previous.join(touched, manifest.KEYS, "left_semi").select(F.explode("days").alias("day"))
            days = sorted(r["day"] for r in before.union(parsed.select("day")).distinct().collect())
            kept = self.records(days).join(touched, manifest.KEYS, "left_anti")
            body = staged(kept.unionByName(parsed), "body")
            left = {r["day"] for r in body.select("day").distinct().collect()}
            body.withColumn("p", F.date_format("day", "yyyy-MM-dd")).write.partitionBy(
                "p").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self._path("records"))
            self._drop_empty_days([d for d in days if d not in left])
            upkeep = staged(manifest.with_days(current, previous, fresh, parsed), "manifest")
            upkeep.select(*self.index().columns).write.mode("overwrite").parquet(self._path("manifest"))
        finally:
            self.files.delete(stage)
        return sum(row["files"] for row in todo)

    def _drop_empty_days(self, days: list[date]) -> None:
        """Remove folders of days whose every row came from vanished files."""
        for day in days:
            self.files.delete(self._path("records", f"p={day.isoformat()}"))
