"""A local session for tests and benchmarks; clusters bring their own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, scratch: str | None = None, memory: str = "8g") -> SparkSession:
    """local[cpus] with UTC, adaptive execution and few shuffle partitions.

    ``scratch`` holds shuffle files, checkpoints and the warehouse.
    """
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("repolith")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if scratch:
        b = b.config("spark.local.dir", scratch).config("spark.checkpoint.dir", f"file://{scratch}/shared").config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
    return b.getOrCreate()
