"""Queries over whole tables, against a walk over a few rows."""

import pytest

from repolith.plans import queries as P

LINES = [(1, 1, 1, 1), (1, 2, 2, 2), (1, 3, 1, 3), (2, 3, 3, 4), (3, 4, 1, 5), (3, 7, 2, 2), (3, 7, 2, 3)]  # order, part, supplier, line number
ORDERS = [(1, 1, "1996-01-01", 5.0), (2, 1, "1999-01-01", 7.0), (3, 2, "1997-01-01", 3.0), (5, 3, "2000-01-01", 4.0), (8, 4, "1996-01-01", 2.0), (11, 4, "1999-01-01", 2.0)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    put("lineitem", LINES, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, t string, o_totalprice double").selectExpr("o_orderkey", "o_custkey", "cast(t as timestamp) as o_orderdate", "o_totalprice").write.parquet(f"{d}/orders.parquet")
    put("supplier", [(1, 1, 10.0), (2, 1, 5000.0), (3, 2, 5000.0)], "s_suppkey long, s_nationkey int, s_acctbal double")
    put("nation", [(1,), (2,), (3,)], "n_nationkey int")
    put("customer", [(1, "BUILDING"), (2, "BUILDING"), (3, "MACHINERY")], "c_custkey long, c_mktsegment string")
    return d


def links():
    e = {(f"c{c}", f"o{o}") for o, c, _, _ in ORDERS} | {("s1", "n1"), ("s2", "n1"), ("s3", "n2")}
    return e | {(f"o{o}", f"p{p}") for o, p, _, _ in LINES} | {(f"p{p}", f"s{s}") for _, p, s, _ in LINES}


def walk(start, step, depth):
    """Node to least depth."""
    seen, front = {start: 0}, {start}
    for k in range(1, depth + 1):
        front = {y for x in front for y in step(x)} - set(seen)
        seen |= dict.fromkeys(front, k)
    return seen


def ordered_walk(start, step, depth, most):
    """(node, depth, via, place) of a walk by levels, as a queue gives it."""
    seen, out, front = {start}, [], [start]
    for k in range(1, depth + 1):
        then = []
        for x in front:
            for y in step(x):
                if y not in seen and len(out) < most:
                    seen.add(y)
                    then.append(y)
                    out.append((y, k, x, len(out) + 1))
        front = then
    return out


def test_whole_tables(spark, tables):
    e = links()
    assert {tuple(r) for r in P._links(spark, tables).collect()} == e
    into = {n: sum(b == n for _, b in e) for n in {b for _, b in e}}
    assert [tuple(r) for r in P.hotspots(spark, tables).collect()] == sorted(into.items(), key=lambda x: (-x[1], x[0]))[:10]
    want = set()
    for n in ("n1", "n2", "n3"):
        want |= {(n, *r) for r in ordered_walk(n, lambda x: sorted(a for a, b in e if b == x), 3, 200)}
    assert {tuple(r) for r in P.reachable_dependents(spark, tables).collect()} == want
    ends = {"n1", "n2", "n3", "s1"}
    want = {(c, x, k) for c in ("c1", "c2") for x, k in walk(c, lambda x: {b for a, b in e if a == x}, 4).items() if x in ends}
    assert {tuple(r) for r in P.attack_paths(spark, tables).collect()} == want and max(k for _, _, k in want) == 4
    assert {tuple(r) for r in P.dependency_diff(spark, tables).collect()} == {(1, "updated"), (2, "removed"), (3, "added")}
