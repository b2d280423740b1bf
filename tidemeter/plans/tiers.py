"""A mart whose work per batch does not grow with its history.

``RunStore`` keeps mergeable partial aggregates as immutable runs, partitioned by month. A batch adds a small run;
``fan`` runs of one size merge into one of the next, so a row is rewritten as often as the number of batches has
digits and a reader meets few runs. Which runs count stands in a manifest, a new file for each change that only one
writer can create. ``TieredMart`` publishes from it: the periods that new rows touch are computed from the months
around them and written, all others stay where an earlier version put them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.operators import registry as rg
from tidemeter.operators.cube import COVERAGE, usage_cube
from tidemeter.operators.entities import entity_cube
from tidemeter.operators.snapshot import day_digests
from tidemeter.plans.files import Files
from tidemeter.schema import COUNTERS, PARTS
from tidemeter.sources.sinks import nested_periods

FAN, KEEP, ATTEMPTS = 8, 2, 20
_SUMS = ("calls", *COUNTERS, *PARTS, *COVERAGE)


def _month(day) -> F.Column:
    return F.date_format(day, "yyyy-MM")


def beside(month: str, step: int) -> str:
    """The month before (-1) or after (1)."""
    year, number = map(int, month.split("-"))
    place = year * 12 + number - 1 + step
    return f"{place // 12:04d}-{place % 12 + 1:02d}"


class Versions:
    """JSON documents that follow each other, each created once; readers take the last one."""

    def __init__(self, files: Files, folder: str, empty: dict):
        self.files, self.folder, self.empty = files, folder, empty

    def numbers(self) -> list[int]:
        return [int(n) for n in self.files.names(self.folder) if n.isdigit()]

    def get(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.folder}/{number:012d}"))

    def last(self) -> tuple[int, dict]:
        found = self.numbers()
        return (found[-1], self.get(found[-1])) if found else (0, dict(self.empty))

    def follow(self, number: int, document: dict) -> bool:
        """Write the successor of ``number``; False if another writer was first."""
        return self.files.create_once(f"{self.folder}/{number + 1:012d}", json.dumps(document))

    def retire(self, keep: int = KEEP) -> tuple[list[dict], list[dict]]:
        """Delete all but the last ``keep``: (kept, deleted) documents."""
        numbers = self.numbers()
        gone = [self.get(n) for n in numbers[:-keep]]
        for n in numbers[:-keep]:
            self.files.delete(f"{self.folder}/{n:012d}")
        return [self.get(n) for n in numbers[-keep:]], gone


class RunStore:
    """Partial aggregates with a ``day``; ``merge`` sums rows of equal keys and may be applied any number of times."""

    def __init__(self, spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame], fan: int = FAN):
        self.spark, self.root, self.merge, self.fan = spark, root.rstrip("/"), merge, fan
        self.files = Files(spark, self.root)
        self.versions = Versions(self.files, f"{self.root}/manifest", {"runs": [], "seen": {}, "changed": {}})

    def _write(self, frame: DataFrame, level: int) -> dict:
        folder = f"{level}-{uuid.uuid4().hex[:12]}"
        frame.withColumn("p", _month("day")).write.partitionBy("p").parquet(f"{self.root}/runs/{folder}")
        months = [n.removeprefix("p=") for n in self.files.names(f"{self.root}/runs/{folder}") if n.startswith("p=")]
        return {"folder": folder, "level": level, "months": months}

    def _load(self, runs: Iterable[dict], months: Iterable[str] | None = None) -> DataFrame | None:
        wanted = None if months is None else set(months)
        paths = [f"{self.root}/runs/{r['folder']}/p={m}" for r in runs for m in r["months"] if wanted is None or m in wanted]
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, frame: DataFrame, query: str, number: int) -> bool:
        """Add the rows of a query's batch, once: a batch that was added before, by number, adds nothing."""
        run = None
        for _ in range(ATTEMPTS):
            at, held = self.versions.last()
            if number <= held["seen"].get(query, -1):
                return False
            run = run or self._write(self.merge(frame), 0)
            changed = held["changed"] | {m: at + 1 for m in run["months"]}
            seen = held["seen"] | {query: number}
            if self.versions.follow(at, {"runs": [*held["runs"], *([run] if run["months"] else [])], "seen": seen, "changed": changed}):
                self.compact()
                return True
        raise RuntimeError("other writers were first each time")

    def compact(self) -> None:
        """Merge levels that are full; a merge that loses a race is left to the winner."""
        while True:
            at, held = self.versions.last()
            levels = sorted({r["level"] for r in held["runs"]})
            full = next((lv for lv in levels if sum(r["level"] == lv for r in held["runs"]) >= self.fan), None)
            if full is None:
                break
            mine = [r for r in held["runs"] if r["level"] == full]
            run = self._write(self.merge(self._load(mine)), full + 1)
            if not self.versions.follow(at, held | {"runs": [*(r for r in held["runs"] if r["level"] != full), run]}):
                self.files.delete(f"{self.root}/runs/{run['folder']}")
                return
        kept, gone = self.versions.retire()
        alive = {r["folder"] for d in kept for r in d["runs"]}
        for folder in {r["folder"] for d in gone for r in d["runs"]} - alive:
            self.files.delete(f"{self.root}/runs/{folder}")

    def read(self, months: Iterable[str] | None = None) -> DataFrame | None:
        """Merged rows, of all or the given months; only their folders are listed. None where there are none."""
        rows = self._load(self.versions.last()[1]["runs"], months)
        return None if rows is None else self.merge(rows)

    def changed_since(self, version: int) -> tuple[int, list[str]]:
        """The newest version and the months that got rows after ``version``."""
        at, held = self.versions.last()
        return at, sorted(m for m, v in held["changed"].items() if v > version)


def merge_hours(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "hour", "source", "model").agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def merge_entities(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "entity", "model").agg(
        F.sum("total").alias("total"), F.sum("calls").alias("calls"), F.min("first_day").alias("first_day"))


def merge_models(rows: DataFrame) -> DataFrame:
    """First and last activity of each model, filed under the first day it was seen."""
    return rows.groupBy("model").agg(
        F.min("first_ts").alias("first_ts"), F.min("first_day").alias("first_day"), F.max("latest").alias("latest")).withColumn("day", F.col("first_day"))


class TieredMart:
    """Hour, project, session and model state in runs, and published periods by month."""

    def __init__(self, spark: SparkSession, root: str, fan: int = FAN):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)
        store = lambda name, merge: RunStore(spark, f"{self.root}/{name}", merge, fan)
        self.hours, self.models = store("hours", merge_hours), store("models", merge_models)
        self.projects, self.sessions = store("projects", merge_entities), store("sessions", merge_entities)
        self.versions = Versions(
            self.files, f"{self.root}/published", {"snapshot_id": None, "through": 0, "seats": [], "parts": {}, "digests": {}})

    def add_batch(self, rec: DataFrame, query: str, number: int) -> None:
        rec = rec.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            cube = usage_cube(rec)
            # Hours come last: what publishing looks at is complete when it appears there.
            self.models.add(rg.model_activity(cube).withColumn("day", F.col("first_day")), query, number)
            self.projects.add(entity_cube(rec, "project"), query, number)
            self.sessions.add(entity_cube(rec, "session"), query, number)
            self.hours.add(cube, query, number)
        finally:
            rec.unpersist()

    def seats(self) -> list[str]:
        """Models by seat, from the maintained state: at most seven."""
        activity = self.models.read()
        return [] if activity is None else [r["model"] for r in rg.seats(activity).orderBy("slot").collect()]

    def publish(self) -> str:
        """``published`` when periods changed, else ``unchanged``; a failure leaves the version before."""
        version, held = self.versions.last()
        through, touched = self.hours.changed_since(held["through"])
        if not touched:
            return "unchanged"
        seats = self.seats()
        if seats != held["seats"]:
            touched = sorted(self.hours.versions.last()[1]["changed"])  # every period names its models anew
        # A week is filed under the month of its first day and may end in the next one.
        parts = sorted({m for t in touched for m in (beside(t, -1), t)})
        cube = self.hours.read({m for p in parts for m in (p, beside(p, 1))}).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            fresh = cube.where(_month("day").isin(touched))
            # A digest for each day of the touched months.
            digests = held["digests"] | {r["day"].isoformat(): r["digest"] for r in day_digests(fresh).collect()}
            ident = hashlib.sha256(";".join(sorted(f"{d}={x}" for d, x in digests.items())).encode()).hexdigest()[:24]
            slots = self.spark.createDataFrame([(m, i) for i, m in enumerate(seats)], "model string, slot bigint")
            rows = nested_periods(rg.fold(cube, slots)).withColumn("p", F.substring("period", 1, 7)).where(F.col("p").isin(parts))
            folder = f"{version + 1:012d}-{uuid.uuid4().hex[:8]}"
            rows.write.partitionBy("p").parquet(f"{self.root}/data/{folder}")
        finally:
            cube.unpersist()
        written = [n.removeprefix("p=") for n in self.files.names(f"{self.root}/data/{folder}") if n.startswith("p=")]
        document = {"snapshot_id": ident, "through": through, "seats": seats, "digests": digests, "parts": held["parts"] | {m: folder for m in written}}
        if not self.versions.follow(version, document):
            self.files.delete(f"{self.root}/data/{folder}")
            return "unchanged"  # another writer published; what it left out is still marked as changed
        kept, gone = self.versions.retire()
        alive = {f for d in kept for f in d["parts"].values()}
        for name in {f for d in gone for f in d["parts"].values()} - alive:
            self.files.delete(f"{self.root}/data/{name}")
        return "published" if ident != held["snapshot_id"] else "unchanged"

    def current(self) -> DataFrame:
        """All published periods: each month from the version that wrote it last."""
        parts = self.versions.last()[1]["parts"]
        return self.spark.read.parquet(*[f"{self.root}/data/{folder}/p={m}" for m, folder in sorted(parts.items())])

    def snapshot(self) -> str | None:
        return self.versions.last()[1]["snapshot_id"]
