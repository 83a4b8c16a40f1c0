"""Detectors side by side: each its own Spark job under a tag, with a deadline; one that fails takes no other with it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from repolith.shared import shared_folder

#: Seconds that a detector may take.
DEADLINE = 60.0
RUNS = "id string, status string, duration_ms long, findings long, message string"
UNAVAILABLE = "Prerequisites not available in this environment."


@dataclass(frozen=True)
class Detector:
    """``find`` gives the findings of files; ``available`` tells whether it can run on them at all."""

    id: str
    find: Callable[[DataFrame], DataFrame]
    available: Callable[[DataFrame], bool] = lambda files: True


def run_detectors(files: DataFrame, detectors: list[Detector], schema: StructType, deadline: float = DEADLINE, at_once: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings with ``detector``, runs): what each detector finds, and a row for each of their runs.

    A run is ok, skipped (not available) or error (it raised, or took longer than ``deadline``
    seconds from its start; its jobs are then cancelled by their tag).  The findings of a run
    that isn't ok don't count.  Each run writes to a folder of its own in the shared folder and
    is read from there, so a detector is computed once, and a lost executor costs its tasks only.
    ``schema``: the columns that findings have.  All run at once unless ``at_once`` says less.
    """
    spark = files.sparkSession
    sc, base = spark.sparkContext, f"{shared_folder(spark)}/detectors-{uuid.uuid4().hex}"

    def one(detector: Detector, tag: str, began: list[float]) -> tuple[str, int, str | None]:
        began.append(time.monotonic())
        sc.addJobTag(tag)
        try:
            if not detector.available(files):
                return "skipped", 0, UNAVAILABLE
            found = detector.find(files).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
            found.withColumn("detector", F.lit(detector.id)).write.parquet(f"{base}/{tag}")
            return "ok", spark.read.parquet(f"{base}/{tag}").count(), None
        finally:
            sc.removeJobTag(tag)

    pool = ThreadPoolExecutor(max_workers=at_once or max(1, len(detectors)))
    started = []
    for k, d in enumerate(detectors):
        began: list[float] = []
        tag = f"detector-{k}-{uuid.uuid4().hex[:8]}"
        started.append((d, tag, began, pool.submit(inheritable_thread_target(spark)(one), d, tag, began)))
    rows, kept = [], []
    for d, tag, began, job in started:
        status, n, message = "error", 0, None
        while True:
            left = deadline if not began else began[0] + deadline - time.monotonic()
            try:
                status, n, message = job.result(timeout=max(left, 0.01))
                if status == "ok":
                    kept.append(tag)
            except Late:
                if not began or time.monotonic() < began[0] + deadline:
                    continue  # it hasn't started, or the wait was short
                sc.cancelJobsWithTag(tag)
                job.cancel()
                message = f"{d.id} exceeded {round(1000 * deadline)}ms"
            except Exception as e:  # whatever a detector raises is its run's message
                message = str(e) or type(e).__name__
            break
        took = round(1000 * (time.monotonic() - began[0])) if began else 0
        rows.append((d.id, status, took, n, message))
    pool.shutdown(wait=False)
    out = StructType([*schema.fields]).add("detector", "string")
    found = spark.read.schema(out).parquet(*[f"{base}/{t}" for t in kept]) if kept else spark.createDataFrame([], out)
    return found, spark.createDataFrame(rows, RUNS)


def statuses(runs: DataFrame) -> Mapping[str, str]:
    """Detector to status, of the bounded table of runs."""
    return {r["id"]: r["status"] for r in runs.collect()}
