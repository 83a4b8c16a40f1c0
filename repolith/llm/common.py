"""Helpers shared by the document operators: staging, Arrow slices, let-binding."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handed to one numpy step; a longer document makes a longer slice.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that setting is missing a local folder is set, on one machine only: executors
    elsewhere would write to their own disks.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="repolith-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged_tables: DataFrame) -> None:
    """Delete the files of tables that ``staged`` gave, once all that reads them is itself staged."""
    for df in staged_tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with so many underscores before it that no frame has such a column."""
    held = {c.lower() for df in frames for c in df.columns}
    while name.lower() in held:
        name = "_" + name
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def text_of(col: str = "text") -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def array_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets) for runs of rows of about ``limit`` bytes.

    A null text has no bytes.  Offsets are relative to the slice's bytes.
    """
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``array_slices`` of a column."""
    return array_slices(batch.column(column), limit)


def stopped_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand at most so many rows of long texts to a Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


FILTER_BITS = 1 << 23


def maybe_in(df: DataFrame, ids: DataFrame, key: str, out: str, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with a column ``out``: false only where ``key`` is not in ``ids``.

    ``ids`` becomes a bitmap of a fixed number of hash bits (1 MB), which is broadcast.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits)) + 1
    maps = ids.select(place(key).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("_bits"))
    d = df.withColumn("_p", place(key)).withColumn("_bucket", F.expr("bitmap_bucket_number(_p)"))
    d = d.join(F.broadcast(maps), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.expr("cast(bitmap_bit_position(_p) div 8 as int)") + 1, F.lit(1))), 16, 10).cast("bigint")
    hit = F.coalesce(F.getbit(byte, F.expr("cast(bitmap_bit_position(_p) % 8 as int)")).cast("int"), F.lit(0))
    return d.select(*df.columns, (hit == 1).alias(out))


def reduced(df: DataFrame, ids: DataFrame, key: str, bits: int = FILTER_BITS, rest: bool = False) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``ids``: a superset of the semi-join.  rest: all other rows.

    An exact join is to follow; this only spares it most of the rows.
    """
    return maybe_in(df, ids, key, "_in", bits).where("not _in" if rest else "_in").drop("_in")
