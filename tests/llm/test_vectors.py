"""Neighbours and whitening of embeddings against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from repolith.llm import curves, queries, whitening

NAN, INF = float("nan"), float("inf")
SPOILT = [(9001, None), (9002, [None, 1.0, 1.0, 1.0]), (9003, [NAN, 1.0, 1.0, 1.0]), (9004, [INF, 1.0, 1.0, 1.0]), (9005, [1.0, 2.0]), (9006, [])]


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id bigint, embedding array<{kind}>, node int, query string")


def plain_nearest(rows, asks, most=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    out = {}
    for q in sorted({i for i in ids if asks(i)}):
        far = np.array([np.sqrt(((x[ids == q][:, None] - x[None]) ** 2).sum(-1)).min(0)])[0]
        best = {}
        for i, s in zip(ids, far, strict=True):
            if i != q:
                best[i] = min(s, best.get(i, s))
        out[int(q)] = [(int(i), s) for i, s in sorted(best.items(), key=lambda z: (z[1], z[0]))[:most]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_hilbert_steps_to_a_neighbour_cell():
    for m, bits in ((2, 4), (3, 3), (1, 5)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * m, indexing="ij"), -1).reshape(-1, m)
        place = curves.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_reaches_recall_and_gives_exact_scores(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want, got = plain_nearest(rows, lambda i: i % 100 == 0), found(queries.op12_neighbours(spark, f"/root/testdata/{sf}"))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    x = dict(rows)
    for q, near in got.items():
        assert near == sorted(near, key=lambda z: (z[1], z[0]))
        assert all(abs(s - np.sqrt(((np.array(x[q]) - np.array(x[i])) ** 2).sum())) < 1e-12 for i, s in near)


def test_recall_with_narrow_windows(spark):
    """Small blocks: windows are a part of the curve; clusters, and noise in as many dimensions as there are."""
    r = np.random.default_rng(5)
    for x in (r.standard_normal((40, 24))[r.integers(0, 40, 6000)] + 0.1 * r.standard_normal((6000, 24)), r.standard_normal((6000, 24))):
        rows = [(i, v) for i, v in enumerate(np.float32(x).tolist())]
        want, got = plain_nearest(rows, lambda i: i % 50 == 0), found(curves.search(table(spark, rows), F.col("vec_id") % 50 == 0, block=64))
        assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_copies_ties_and_spoilt_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(np.float32(r.standard_normal((300, 4))).tolist())]
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(1000, 1400)]  # a third of all rows are one vector
    rows += [(200, rows[7][1]), (200, rows[7][1]), (5, rows[5][1]), (2000, [0.5, 0.5, 0.0, 0.0]), (2001, [0.5, -0.5, 0.0, 0.0])]
    spoilt = [*SPOILT, (9000, [0.0] * 4), (9100, [0.0] * 4), (None, [1.0, 0.0, 0.0, 0.0]), (None, [2.0, 0.0, 0.0, 0.0])]
    got = found(curves.search(table(spark, rows + spoilt), F.col("vec_id") % 100 == 0))
    want = plain_nearest(rows, lambda i: i % 100 == 0)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)
    assert [i for i, _ in got[1100]] == list(range(1000, 1010)) and [i for i, _ in got[1000]] == list(range(1001, 1011))


def test_few_rows_and_empty_tables(spark):
    few = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [0.0, 2.0])]
    assert found(curves.search(table(spark, few, "double"), F.col("vec_id") % 100 == 0)) == {0: [(1, 0.5), (2, 1.0)]}
    assert curves.search(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert curves.search(table(spark, [(1, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0
    assert found(curves.search(table(spark, [(0, [1.0])]), F.col("vec_id") % 100 == 0)) == {}
    assert curves.search(table(spark, SPOILT[:4]), F.lit(True)).count() == 0


def check_whitened(df, ids, x):
    got = sorted(df.collect(), key=lambda r: (r["component"], r["vec_id"]))
    order = np.argsort(ids, kind="stable")
    z = (np.floor(64 * x).astype(int) + 1_000_000)[order]
    n, s = len(z), z.sum(axis=0)
    c = (n * z - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(32, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == n * k
    exact = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s, strict=True)) for row in z]
    for j in range(k):
        part = got[j * n : (j + 1) * n]
        assert [r["vec_id"] for r in part] == sorted(ids) and {r["component"] for r in part} == {j + 1} and {r["n"] for r in part} == {n}
        assert [r["deviation"] for r in part] == exact
        assert abs(part[0]["explained"] - e[j] / e.sum()) < 1e-9 and part[0]["identity_error"] < 1e-9
        want, have = c @ u[:, j] / np.sqrt(e[j]), np.array([r["whitened"] for r in part])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6


def test_query_equals_numpy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    check_whitened(queries.op13_whitening(spark, "/root/testdata/sf0.001"), np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float))


def test_spoilt_rows_copies_and_less_dimensions_than_components(spark):
    r = np.random.default_rng(4)
    x = np.float32(r.standard_normal((200, 4)) * [9, 3, 1, 30]).astype(float)
    x[150:] = x[0]  # copies
    x[:, 3] = 5  # no variance
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    zero = (7000, [0.0] * 4)
    df = whitening.components(table(spark, [*rows, zero, *SPOILT, (9007, [3e30, 1.0, 1.0, 1.0])]))
    check_whitened(df, np.array([i for i, _ in rows] + [7000]), np.vstack([x, np.zeros(4)]))


def test_exact_deviations_beyond_64_bits(spark):
    rows = [(1, [2.0**28, 1.0]), (2, [-(2.0**28), 1.0]), (3, [1.0, 2.0]), (4, [1.5, 5.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.components(table(spark, rows, "double")).collect()}
    assert got.keys() == {1, 2, 3, 4} and got[1] is None and got[3] is not None


def test_tables_without_variance(spark):
    for rows in ([], SPOILT[:4], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.components(table(spark, rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
