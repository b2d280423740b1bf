"""Session construction and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_base: str | None = None


def build_session(app: str = "tidemeter", cpus: int | None = None) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use the session you are given."""
    cores = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's shared ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder on this machine, because there
    driver and executors are the same process.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        base = _local_base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
