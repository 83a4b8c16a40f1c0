"""Whitening of embeddings: exact centring, the Gram matrix by MLlib's RowMatrix, eigenvectors on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.llm.common import staged

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
LARGEST = 2.0**30
_LONG = (1 << 63) - 1


def finite(vector: str) -> Column:
    """True where a vector and all its entries are there and finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False))


def usual_length(df: DataFrame, vector: str) -> int:
    """The length that most vectors have (ties: the larger); 0 for an empty table."""
    top = df.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as a matrix of the entries' type."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n and the sums by dimension of a task's rows."""
    n, total = 0, None
    for b in batches:
        if len(b):
            x = matrix(b.column(0)).sum(axis=0)
            n, total = n + len(b), x if total is None else total + x
    if n:
        kind = pa.list_(pa.int64() if total.dtype.kind == "i" else pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], kind)], ["n", "total"])


def _totals(df: DataFrame, column: str, kind: str) -> tuple[int, list]:
    """(rows, sums by dimension): one row a task is summed by Spark, d numbers reach the driver."""
    part = df.select(column).mapInArrow(_sums, f"n bigint, total array<{kind}>")
    got = part.select("n", F.posexplode("total").alias("k", "v")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("k").collect()
    return (got[0]["n"], [r["v"] for r in got]) if got else (0, [])


def _gram(df: DataFrame, centred: Column) -> np.ndarray:
    """Sum of the outer products of the rows of a column of arrays, d x d, in tasks and then a tree."""
    rows = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(centred).alias("v")), "v")
    return np.asarray(RowMatrix(rows).computeGramianMatrix().toArray())


def _exact(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums over dimensions of (n*x - S)^2 in whole numbers; null where 64 bits don't hold one."""
    far = n * float(np.abs(x).max(initial=0)) + float(np.abs(sums.astype(float)).max(initial=0))
    if far * far * x.shape[1] < _LONG:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    big = [sum((n * c - s) ** 2 for c, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return [v if v <= _LONG else None for v in big]


def whiten(df: DataFrame, vector: str, components: int = COMPONENTS) -> tuple[DataFrame, np.ndarray, int]:
    """(rows with ``deviation`` and ``whitened``, share of variance by component, rows fitted on).

    Entries become whole numbers, floor(64*c) + 1000000.  The rows are centred exactly, their
    covariance (divisor n) is taken apart on the driver, and ``whitened`` has each row's
    projection on the first ``components`` eigenvectors over the root of their eigenvalues.

    Left out: rows whose vector is null or holds null or non-finite entries, and rows of another
    length than most (ties: the larger), and rows with an entry of 2**30 or more, whose sums would not stay exact.
    Directions without variance have no component, so one row, or equal rows only, give none,
    and an empty table gives an empty one.  Repeated rows count each.  Other columns stay, but
    columns named ``deviation`` and ``whitened`` are replaced.
    """
    spark = df.sparkSession
    ok = df.where(finite(vector))
    d = usual_length(ok, vector)
    schema = "deviation bigint, whitened array<double>"
    empty = df.limit(0).withColumn("deviation", F.lit(None).cast("bigint")).withColumn("whitened", F.lit(None).cast("array<double>")), np.zeros(0), 0
    if d <= 0:
        return empty
    scaled = F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("bigint") + OFFSET)
    ok = ok.where((F.size(vector) == d) & ~F.exists(vector, lambda c: F.abs(c) >= LARGEST)).select(*[c for c in df.columns if c.lower() not in ("deviation", "whitened")], scaled.alias("_x"))
    n, sums = _totals(ok, "_x", "bigint")
    if not n:
        return empty
    mean = F.array(*[F.lit(s) for s in sums])
    centred = F.zip_with("_x", mean, lambda x, s: (x.cast("decimal(38,0)") * n - s.cast("decimal(38,0)")).cast("double") / n) if max(map(abs, sums)) * 4 > _LONG else F.zip_with("_x", mean, lambda x, s: (x * n - s).cast("double") / n)
    values, vectors = np.linalg.eigh(_gram(ok, centred) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    whole = float(values.sum())
    kept = int((values[:components] > max(whole, 0) * d * np.finfo(float).eps * 8).sum())
    base = np.array(sums, dtype=np.int64)
    shared = spark.sparkContext.broadcast((n, base, vectors[:, :kept] / np.sqrt(values[:kept])))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, base, ways = shared.value
        for b in batches:
            x = matrix(b.column("_x"))
            far = (x * n - base).astype(float) / n if n * float(np.abs(x).max(initial=0)) < _LONG / 4 else np.array([[float(Decimal(int(n) * c - s) / n) for c, s in zip(r, base.tolist(), strict=True)] for r in x.tolist()])
            out = (far @ ways).reshape(len(x), -1)
            keep = [b.column(k) for k in range(b.num_columns - 1)]
            arrays = [*keep, pa.array(_exact(x, n, base), pa.int64()), pa.array(list(out), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rest = [f for f in ok.schema.fields if f.name != "_x"]
    names = [f.name for f in rest] + ["deviation", "whitened"]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), schema])
    return ok.select(*[f.name for f in rest], "_x").mapInArrow(project, kinds), values[:kept] / whole if kept else np.zeros(0), n


def identity_error(white: DataFrame) -> float:
    """Largest entry, in absolute value, of the covariance of ``whitened`` minus the identity; 0 where there is no component."""
    n, sums = _totals(white, "whitened", "double")
    if not sums:
        return 0.0
    mean = [s / n for s in sums]
    gram = _gram(white, F.zip_with("whitened", F.array(*[F.lit(m) for m in mean]), lambda w, m: w - m))
    return float(np.abs(gram / n - np.eye(len(mean))).max())


def components(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row for each row and component.

    What is left out, and what odd tables give, is as ``whiten`` says; a null key stays null.
    """
    white, explained, n = whiten(df.select(F.col(key).alias("_key"), F.col(vector).alias("_vector")), "_vector", most)
    white = staged(white.select("_key", "deviation", "whitened"), "whitened")
    error = identity_error(white)
    share = F.array(*[F.lit(float(e)) for e in explained]) if len(explained) else F.array().cast("array<double>")
    out = white.select(F.col("_key").alias(key), "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return out.select(key, (F.col("_k") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("_k")).alias("explained"), F.lit(error).alias("identity_error"))
