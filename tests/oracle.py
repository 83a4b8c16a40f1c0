"""A query's rows against its SQL's in DuckDB, over the same tables."""

import math
from pathlib import Path

import duckdb


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ("", None)
    if isinstance(x, bool):
        return ("b", x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return ("n", round(float(x), 6))
    return (type(x).__name__, x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(_plain(r[k]) for k in order) for r in data), key=repr)


def compare(spark, folder, query, sql):
    """(Spark's rows, SQL's rows, pairs of types) with columns by name."""
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    got = con.execute(sql)
    names, kinds = [c[0] for c in got.description], {c[0]: str(c[1]) for c in got.description}
    want = rows(names, got.fetchall())
    df = query(spark, folder)
    types = {c: (t, kinds.get(c)) for c, t in df.dtypes}
    return rows(df.columns, [tuple(r) for r in df.collect()]), want, types
