"""Connected components of an edge table by alternating stars, each round staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm.common import discard, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: link neighbours to the least node that a node sees.

    Only minima are aggregated (in part before the shuffle); a node with very many
    neighbours is split by the skew handling of the join.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(least, "u")
    out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")) if large else out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` reaches.

    Nodes without an edge to another node don't appear.  Self links, repeated and
    reversed links change nothing; an empty table gives an empty one.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    now, seen = staged(now, "edges"), None
    while True:
        r = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30))).alias("s")).first()
        if (r["n"], r["x"], r["s"]) == seen or not r["n"]:
            break
        seen = (r["n"], r["x"], r["s"])
        half = staged(_star(now, True), "edges")
        old, now = now, staged(_star(half, False), "edges")
        discard(old, half)
    top = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(top)
