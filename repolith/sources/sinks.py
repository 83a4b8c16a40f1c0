"""Writing tables: appends, snapshots that replace their former state, inserts and updates by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("append").partitionBy(*by).parquet(path)


def replace_snapshot(rows: DataFrame, path: str, *by: str) -> None:
    """Write ``rows`` in place of all that was there of their values of ``by``; other values stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def inserted(stored: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``stored`` and those of ``rows`` whose key is new; of equal keys in ``rows`` one is taken.  Null keys are always new."""
    known = rows.dropna(subset=list(keys)).dropDuplicates(list(keys)).join(stored.select(*keys).distinct(), list(keys), "left_anti")
    blank = rows.where(" or ".join(f"{k} is null" for k in keys))
    return stored.unionByName(known.select(*stored.columns)).unionByName(blank.select(*stored.columns))


def upserted(stored: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``stored`` with rows of equal keys replaced and those of new keys added; keys in ``rows`` are unique."""
    rest = stored.join(rows.select(*keys), list(keys), "left_anti")
    return rest.unionByName(rows.select(*stored.columns))


def latest(versions: DataFrame, order: str, *keys: str) -> DataFrame:
    """The last version of each key: what upserts in that order leave."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*keys, "_v.*")
