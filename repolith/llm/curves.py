"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected at random several times, and each projection is ordered along a Hilbert
curve over a shifted grid.  Spark partitions the orders by range, a vector's neighbours are
looked for in the window around its place in each order, and those of all windows are ranked by
their distance in the full space.  How wide a window must be is measured: a bounded sample of
the queries is searched exactly, and the window is that in which their neighbours would be found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm.common import discard, staged
from repolith.llm.whitening import finite, matrix, usual_length

#: Curves, dimensions of a projection, bits of a coordinate (dimensions x bits stay below 63).
CURVES, DIMENSIONS, BITS = 8, 8, 7
#: Rows of a curve that are compared at once; a window is made of such blocks.
BLOCK = 2048
#: Queries searched exactly to learn the window, and the share of their neighbours that it must hold.
SAMPLE, RECALL = 128, 0.95
NEAREST = 10


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of grid coordinates (n x m, ``bits`` bits each)."""
    x = places.astype(np.int64).T.copy()
    m = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = np.int64(1) << level, (np.int64(1) << level) - 1
        for i in range(m):
            turned = (x[i] & top) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, m):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[m - 1] >> level) & 1, (np.int64(1) << level) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(m):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


class Curves:
    """Random projections of ``d`` dimensions, each with its shift of the grid."""

    def __init__(self, d: int, curves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.m = min(DIMENSIONS, d)
        self.ways = np.stack([np.linalg.qr(rng.standard_normal((d, self.m)))[0] for _ in range(curves)])
        self.shifts = 2 * rng.random((curves, self.m))
        self.centre = self.spread = None

    def projected(self, x: np.ndarray) -> np.ndarray:
        """curves x rows x dimensions."""
        return np.einsum("nd,tdm->tnm", x, self.ways)

    def fit(self, n: int, total: np.ndarray, squares: np.ndarray) -> None:
        """Grids of ten standard deviations, from sums over all vectors."""
        shape = self.shifts.shape
        self.centre = (total / n).reshape(shape)
        self.spread = np.sqrt(np.maximum((squares / n).reshape(shape) - self.centre**2, 1e-300))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """rows x curves."""
        z = (self.projected(x) - self.centre[:, None]) / self.spread[:, None]
        cell = np.floor((z + 4 + self.shifts[:, None]) / 10 * (1 << BITS))
        cell = np.clip(np.nan_to_num(cell), 0, (1 << BITS) - 1).astype(np.int64)
        return np.stack([hilbert(c, BITS) for c in cell], axis=1)


def _moments(curves: Curves):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                z = curves.projected(matrix(b.column(0)).astype(float))
                n, one, two = n + len(b), one + z.sum(axis=1).ravel(), two + (z * z).sum(axis=1).ravel()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.concatenate([one, two]).tolist()], pa.list_(pa.float64()))], ["n", "v"])

    return of


def _keys(curves: Curves):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                k = curves.keys(matrix(b.column("vector")).astype(float))
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(list(k), pa.list_(pa.int64()))], ["node", "keys"])

    return of


_FOUND = "query bigint, node bigint, least bigint, distance double"


def _best(q: np.ndarray, x: np.ndarray, least: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, distances): of each query the ``most`` nearest rows, ties to the smaller ``least``.

    A product of matrices leaves those that may be among them; distances are of differences.
    """
    own = (x * x).sum(axis=1)
    for first in range(0, len(q), 256):
        part = q[first : first + 256]
        size = (part * part).sum(axis=1)[:, None]
        rough = size + own[None, :] - 2 * (part @ x.T)
        slack = 256 * np.finfo(float).eps * x.shape[1] * (size[:, 0] + own.max())
        limit = (np.partition(rough, most - 1, axis=1)[:, most - 1] if most < len(x) else np.full(len(part), np.inf)) + slack
        for k in range(len(part)):
            rows = np.flatnonzero(rough[k] <= limit[k])
            far = np.sqrt(((x[rows] - part[k]) ** 2).sum(axis=1))
            order = np.lexsort((least[rows], far))[:most]
            yield first + k, rows[order], far[order]


def _table(query: list, node: list, least: list, distance: list) -> pa.Table:
    cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
    return pa.table([cat(query, pa.int64()), cat(node, pa.int64()), cat(least, pa.int64()), cat(distance, pa.float64())], ["query", "node", "least", "distance"])


def _nearest(queries: np.ndarray, q: np.ndarray, nodes: np.ndarray, least: np.ndarray, x: np.ndarray, most: int) -> pa.Table:
    out: tuple[list, list, list, list] = ([], [], [], [])
    for k, rows, far in _best(q, x, least, most):
        for held, values in zip(out, (np.full(len(rows), queries[k]), nodes[rows], least[rows], far), strict=True):
            held.append(values)
    return _table(*out)


def _in_block(most: int):
    def of(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return _table([], [], [], [])
        rows, asked = rows.combine_chunks(), asked.combine_chunks()
        x, q = (matrix(t.column("vector").chunk(0)).astype(float) for t in (rows, asked))
        ints = lambda t, c: t.column(c).to_numpy()
        return _nearest(ints(asked, "query"), q, ints(rows, "node"), ints(rows, "least"), x, most)

    return of


def _exactly(queries: np.ndarray, q: np.ndarray, most: int):
    """The nearest rows of a task to a few queries."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if len(b):
                t = _nearest(queries, q, b.column("node").to_numpy(), b.column("least").to_numpy(), matrix(b.column("vector")).astype(float), most)
                held = t if held is None else pa.concat_tables([held, t])
                if len(held) > 8 * most * len(queries):
                    held = _trimmed(held, most)
        if held is not None:
            yield from _trimmed(held, most).combine_chunks().to_batches()

    return of


def _trimmed(t: pa.Table, most: int) -> pa.Table:
    t = t.sort_by([("query", "ascending"), ("distance", "ascending"), ("least", "ascending")])
    q = t.column("query").to_numpy()
    first = np.searchsorted(q, q, side="left")
    return t.filter(pa.array(np.arange(len(q)) - first < most))


def _top(df: DataFrame, by: str, most: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _orders(nodes: DataFrame, d: int, curves: int) -> tuple[DataFrame, int, DataFrame]:
    """(t, node, rank) of every node along every curve, the number of nodes, the table behind."""
    spark = nodes.sparkSession
    ways = Curves(d, curves)
    got = nodes.select("vector").mapInArrow(_moments(ways), "n bigint, v array<double>")
    got = got.select("n", F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("k").collect()
    n, sums = got[0]["n"], np.array([r["v"] for r in got])
    ways.fit(n, *np.split(sums, 2))
    keys = nodes.select("node", "vector").mapInArrow(_keys(ways), "node bigint, keys array<bigint>")
    keys = keys.select("node", F.posexplode("keys").alias("t", "key"))
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(n * curves / 1_000_000))
    placed = keys.repartitionByRange(parts, "t", "key", "node").sortWithinPartitions("t", "key", "node")
    placed = staged(placed.select("t", "node", F.monotonically_increasing_id().alias("at")), "placed")  # partition << 33 | row in it
    counts = {r["p"]: r["n"] for r in placed.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(counts):
        starts.append((p, before))
        before += counts[p]
    starts = spark.createDataFrame(starts, "p bigint, start bigint")
    ranked = placed.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("p"))
    rank = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) - F.col("t") * F.lit(n).cast("bigint")
    return ranked.select("t", "node", rank.alias("rank")), n, placed


def _window(asked: DataFrame, nodes: DataFrame, orders: DataFrame, near: int, sample: int, recall: float) -> int:
    """Half the width, in ranks, within which ``recall`` of the sampled queries' neighbours lie on one curve or another."""
    drawn = asked.orderBy(F.xxhash64("query"), "query").limit(sample).collect()
    queries, q = np.array([r["query"] for r in drawn]), np.array([r["vector"] for r in drawn], dtype=float)
    found = nodes.select("node", "least", "vector").mapInArrow(_exactly(queries, q, near), _FOUND)
    pairs = [(r["query"], r["node"]) for r in _top(found, "query", near, F.col("distance"), F.col("least")).collect() if r["query"] != r["node"]]
    if not pairs:
        return 0
    wanted = nodes.sparkSession.createDataFrame([(int(x),) for x in sorted({x for p in pairs for x in p})], "node bigint")
    places: dict[int, dict[int, int]] = {}
    for r in orders.join(F.broadcast(wanted), "node").collect():
        places.setdefault(r["node"], {})[r["t"]] = r["rank"]
    apart = sorted(min(abs(places[a][t] - places[b][t]) for t in places[a]) for a, b in pairs)
    return apart[min(len(apart) - 1, math.ceil(recall * len(apart)))]


def search(df: DataFrame, query: Column, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, curves: int = CURVES, block: int = BLOCK, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, <key>, score): the nearest rows found of every row for which ``query`` holds.

    Nearest by Euclidean distance in double precision, ties to the smaller key; fewer rows than
    ``nearest`` are all found.  Every row is indexed; equal vectors once, with their
    ``nearest`` + 1 smallest keys, so that many copies make no crowded place.  The windows hold
    ``recall`` of the neighbours of up to ``sample`` queries; of the rest, about as many.

    Rows whose key or vector is null, whose vector is zero or holds null or non-finite entries, or has
    another length than most (ties: the larger) take no part.  Rows of one key are one: a query
    finds no row of its key, and of a key's several vectors the nearest counts.  Tables without a
    query or empty give an empty result; other columns, whatever their names, don't matter.
    """
    spark = df.sparkSession
    d = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"), F.coalesce(query, F.lit(False)).alias("asks"))
    ok = d.where(F.col("id").isNotNull() & finite("vector") & F.exists("vector", lambda c: c != 0))
    size = usual_length(ok, "vector")
    kinds = f"query_id bigint, rank int, {key} bigint, score double"
    if size <= 0:
        return spark.createDataFrame([], kinds)
    ok = ok.where(F.size("vector") == size)
    ids = _top(ok.select("id", "vector").distinct(), "vector", nearest + 1, F.col("id"))
    nodes = ids.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), "vector", "ids", F.col("ids")[0].alias("least")), "nodes")
    queries = staged(ok.where("asks").select("id", "vector").distinct().join(nodes.select("node", "vector"), "vector").select(F.col("id").alias("query_id"), F.col("node").alias("query")), "queries")
    asked = queries.select("query").distinct().join(nodes.select(F.col("node").alias("query"), "vector"), "query")
    asked = staged(asked, "asked")
    if asked.isEmpty():
        return spark.createDataFrame([], kinds)
    orders, n, placed = _orders(nodes, size, curves)
    half = _window(asked, nodes, orders, nearest + 1, sample, recall)
    last = F.lit((n - 1) // block)
    near = orders.withColumnRenamed("node", "query").join(asked, "query")
    first = F.floor(F.greatest(F.col("rank") - half, F.lit(0)) / block)
    near = near.select(F.col("t").alias("curve"), "query", "vector", F.explode(F.sequence(first.cast("bigint"), F.least(F.floor((F.col("rank") + half) / block), last).cast("bigint"))).alias("window"))
    rows = orders.join(nodes.select("node", "least", "vector"), "node").select("t", F.floor(F.col("rank") / block).cast("bigint").alias("block"), "node", "least", "vector")
    found = rows.groupBy("t", "block").cogroup(near.groupBy("curve", "window")).applyInArrow(_in_block(nearest + 1), _FOUND)
    found = found.groupBy("query", "node", "least").agg(F.min("distance").alias("distance"))
    found = _top(found, "query", nearest + 1, F.col("distance"), F.col("least")).drop("rank")
    found = found.join(nodes.select("node", F.explode("ids").alias("id")), "node")
    found = staged(_top(found, "query", nearest + 1, F.col("distance"), F.col("id")).select("query", "id", "distance"), "nearest")
    discard(placed, nodes, asked)
    out = queries.join(found, "query").where("id <> query_id").groupBy("query_id", "id").agg(F.min("distance").alias("score"))
    out = _top(out, "query_id", nearest, F.col("score"), F.col("id"))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
