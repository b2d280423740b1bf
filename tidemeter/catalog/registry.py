"""Query registration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tidemeter.operators.cube import additive, usage_cube
from tidemeter.operators.entities import entity_cube, entity_pass
from tidemeter.operators.registry import fold, registry
from tidemeter.sources import tables

ADAPTERS = {"ev": tables.usage_events, "gp": tables.usage_gaps, "ln": tables.usage_lines}


class Tables:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._kept: dict[tuple[str, str], DataFrame] = {}

    def _once(self, kind: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if (kind, name) not in self._kept:
            self._kept[kind, name] = build()
        return self._kept[kind, name]

    def rec(self, name: str) -> DataFrame:
        return self._once("rec", name, lambda: ADAPTERS[name](self.spark, self.root))

    def cube(self, name: str, keys: str = "day hour source model") -> DataFrame:
        """The usage cube by the named keys, left lazy so that only used columns are read."""
        return self._once(f"cube {keys}", name, lambda: usage_cube(self.rec(name), keys.split()))

    def slots(self, name: str) -> DataFrame:
        """At most seven rows, read by every fold of a query."""
        return self._once(
            "slots", name,
            lambda: registry(self.cube(name, "day model")).persist(StorageLevel.MEMORY_AND_DISK))

    def folded(self, name: str, keys: str = "day hour source model") -> DataFrame:
        return self._once(f"folded {keys}", name, lambda: fold(self.cube(name, keys), self.slots(name)))

    def kept(self, name: str, keys: str, *columns: str) -> DataFrame:
        """The folded cube with some sums, persisted for queries that branch over it.

        It is calendar-sized; lost partitions are recomputed from the records.
        """
        return self._once(
            f"kept {keys} {columns}", name,
            lambda: additive(self.folded(name, keys), keys.split(), list(columns)).persist(
                StorageLevel.MEMORY_AND_DISK))

    def entities(self, name: str, kind: str, keys: str = "entity model", grain: str | None = None) -> DataFrame:
        """The project or session cube by the named keys, under folded model names."""
        slots = self.slots(name) if "model" in keys else None
        return self._once(
            f"{kind} {keys} {grain}", name, lambda: entity_cube(self.rec(name), kind, keys.split(), slots, grain))

    def kept_entities(
        self, name: str, kind: str, keys: str = "day entity", grain: str | None = None
    ) -> DataFrame:
        """An entity cube that several branches read; it spills to executor disks."""
        return self._once(
            f"kept {kind} {keys} {grain}", name,
            lambda: self.entities(name, kind, keys, grain).persist(StorageLevel.MEMORY_AND_DISK))

    def passed(self, name: str, kind: str) -> DataFrame:
        """The entity pass of a kind: a row per day and per distinct total, so no entity is kept."""
        return self._once(
            f"pass {kind}", name,
            lambda: entity_pass(self.entities(name, kind, "day entity")).persist(StorageLevel.MEMORY_AND_DISK))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, root: str) -> DataFrame:
        return self.build(Tables(spark, root))


CATALOG: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a builder under its function name; ``covers`` lists operator ids."""

    def add(build: Callable[[Tables], DataFrame]):
        if build.__name__ in CATALOG:
            raise ValueError(f"duplicate query {build.__name__}")
        CATALOG[build.__name__] = Query(build.__name__, covers, build, sql)
        return build

    return add
