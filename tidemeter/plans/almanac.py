"""A store of report snapshots: keyed upserts on versioned folders.

Each change writes a whole new version (some hundred small rows: scopes and snapshots are limited) into a folder of
its own and then creates the pointer file of the next number, which only one writer can. A reader follows the
highest pointer, so it sees the old version or the new one and never part of either; a writer that lost the race
starts again from what the other one stored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.operators import almanac as al
from tidemeter.operators.seasons import KEEP_SCOPES, KEEP_SNAPSHOTS, upsert_history
from tidemeter.plans.files import Files

#: Versions that stay readable, and attempts against other writers.
KEEP_VERSIONS, ATTEMPTS = 2, 20
EXPORT_VERSION = 1


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, keep: int = KEEP_SNAPSHOTS, scopes: int = KEEP_SCOPES):
        self.spark, self.root, self.keep, self.scopes = spark, root.rstrip("/"), keep, scopes
        self.files = Files(spark, self.root)

    def _pointers(self) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/pointers") if n.isdigit()]

    def version(self) -> int:
        found = self._pointers()
        return int(found[-1]) if found else 0

    def snapshots(self, version: int | None = None) -> DataFrame:
        """All stored snapshots of the newest (or a kept) version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], al.SNAPSHOT)
        folder = json.loads(self.files.read(f"{self.root}/pointers/{version:012d}"))["folder"]
        return self.spark.read.schema(al.SNAPSHOT).parquet(f"{self.root}/data/{folder}")

    def _commit(self, change: Callable[[DataFrame], DataFrame]) -> int:
        for _ in range(ATTEMPTS):
            version = self.version()
            folder = f"{version + 1:012d}-{uuid.uuid4().hex[:8]}"
            change(self.snapshots(version)).coalesce(1).write.parquet(f"{self.root}/data/{folder}")
            if self.files.create_once(f"{self.root}/pointers/{version + 1:012d}", json.dumps({"folder": folder})):
                self._retire(version + 1)
                return version
            self.files.delete(f"{self.root}/data/{folder}")
        raise RuntimeError("other writers were first each time")

    def _retire(self, version: int) -> None:
        for name in self._pointers():
            if int(name) <= version - KEEP_VERSIONS:
                folder = json.loads(self.files.read(f"{self.root}/pointers/{name}"))["folder"]
                self.files.delete(f"{self.root}/pointers/{name}")
                self.files.delete(f"{self.root}/data/{folder}")

    def put(self, fresh: DataFrame) -> int:
        """Insert or replace snapshots by (scope, id); returns the version that was there before.

        A scope keeps its latest snapshots, and the store the scopes that were written last.
        """
        def change(old: DataFrame) -> DataFrame:
            now = fresh.groupBy("scope").agg(F.max("updated").alias("_now"))
            kept = old.join(F.broadcast(now), "scope", "left").withColumn("updated", F.coalesce("_now", "updated")).drop("_now")
            return upsert_history(kept, fresh, self.keep, self.scopes, "updated")

        return self._commit(change)

    def observe(self, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Store a snapshot; (records against history, stories), both against what was stored before it.

        The answers read the version that the write replaced, which is kept until the next but one.
        """
        fresh = self.spark.createDataFrame(fresh.collect(), al.SNAPSHOT)  # one row per scope
        history = self.snapshots(self.put(fresh))
        return al.compare_records(fresh, al.earlier(history, fresh)), al.stories(fresh, history)

    def clear(self, scope: str | None = None) -> None:
        """Forget one scope, or everything."""
        self._commit(lambda old: old.where("false") if scope is None else old.where(F.col("scope") != scope))

    def export(self, scope: str, path: str) -> None:
        """One scope as one JSON object: no project, session, title or single turn is in it."""
        mine = self.snapshots().where(F.col("scope") == scope)
        names = [c for c in mine.columns if c not in ("scope", "updated")]
        held = mine.groupBy("scope").agg(
            F.max("updated").alias("updated"), F.max_by("id", F.struct("generated", "id")).alias("exported_from"),
            F.transform(F.array_sort(F.collect_list(F.struct("generated", "id", F.to_json(F.struct(*names)).alias("body")))), lambda s: s["body"]).alias("bodies"))
        # Maps cannot be sorted, so snapshots are sorted as (time, id, text) and the text parsed back.
        body = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in mine.schema.fields if f.name in names)
        held.select(
            F.lit(EXPORT_VERSION).alias("version"), "exported_from", "scope", "updated",
            F.transform("bodies", lambda b: F.from_json(b, f"struct<{body}>")).alias("snapshots"),
        ).coalesce(1).write.mode("overwrite").json(path)
