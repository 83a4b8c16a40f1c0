"""Set-similarity join over word shingles with a token-group matrix.

Documents with the same set are one node.  Nodes that share too few tokens with all
others to link at all are taken out; nodes with the same most frequent token form a
group; the matrix holds each group's token union.  A query's overlap with a
union bounds its overlap with every member, so only groups that pass the bound are
opened, and what is found there is verified on the whole texts, block by block.
Members that link to their group's pivot need no comparison with each other.

Tokens are those of a node's prefix in one global order, frequent tokens last: two
sets that link share at least ``need`` tokens of their prefixes.  The order reads a
table of fixed size; any order gives the same links, a good one gives short lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm import hashing
from repolith.llm.common import discard, fresh, reduced, staged, text_of, text_slices
from repolith.llm.components import components

WIDTH, PERCENT = 5, 80
#: Hash buckets whose frequency orders the tokens; 256 kB once broadcast.
BUCKET_BITS = 18
#: Tokens of a group's nodes that one task compares with as many others at once; 2 MB of hashes.
BLOCK = 1 << 18
#: Times that nodes which cannot link are taken out before groups are formed.
ROUNDS = 2
#: Pairs of classes of a group's nodes to compare: members linked to the pivot (R) or not
#: (U), queries from other groups that reach the pivot (E) or not (F).
OPEN = ("UU", "UR", "RU", "FR", "RF", "FU", "UF", "EU", "UE")


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's runs of ``width`` lower-cased words.

    A row of fewer words has its whole sequence as one; without words it has none.
    """
    words, bounds = hashing.words(raw, offs)
    runs, begins = hashing.runs(words, bounds, width)
    out = []
    for k in range(len(offs) - 1):
        n = int(bounds[k + 1] - bounds[k])
        if n >= width:
            out.append(np.unique(runs[begins[k] : begins[k + 1]]))
        else:
            out.append(hashing.runs(words[bounds[k] : bounds[k + 1]], np.array([0, n]), n)[0] ^ np.uint64(n) if n else np.zeros(0, np.uint64))
    return out


def _set_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bucket(s: np.ndarray) -> np.ndarray:
    return (hashing.mix(s) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def nodes_and_buckets(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n) of each document, and rows (bucket, n) of frequent hash buckets."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for batch in batches:
            keys, sizes = [], []
            for _, raw, offs in text_slices(batch):
                for s in shingle_sets(raw, offs):
                    keys.append(_set_key(s) if len(s) else None)
                    sizes.append(len(s))
                    np.add.at(seen, _bucket(s), 1)
            rows += len(keys)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(len(keys), pa.int64())], ["doc_id", "node", "n", "bucket"])
        hot = np.flatnonzero(seen >= max(8, 4 * seen.mean(), rows // 512))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(hot), pa.int64()), pa.nulls(len(hot), pa.int64()), pa.array(seen[hot], pa.int64()), pa.array(hot, pa.int64())], ["doc_id", "node", "n", "bucket"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(step, "doc_id long, node long, n long, bucket long")


def token_order(buckets: DataFrame) -> np.ndarray:
    """Weight of each hash bucket, 0 for all but frequent ones; at most 2 ** BUCKET_BITS rows reach the driver."""
    weights = np.zeros(1 << BUCKET_BITS, np.uint8)
    for r in buckets.groupBy("bucket").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("w")).collect():
        weights[r["bucket"]] = r["w"]
    return weights


def need(n: str) -> Column:
    """Least number of prefix tokens that a set of n tokens shares with any set it links to."""
    return F.lit(1) + F.floor(F.col(n) / 25)


def prefix_tokens(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(token, node, n, hot): each node's prefix; copies within a batch give it once."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for _, raw, offs in text_slices(batch):
                parts = []
                for s in shingle_sets(raw, offs):
                    n = len(s)
                    if not n or (key := _set_key(s)) in seen:
                        continue
                    seen.add(key)
                    order = np.argsort(held.value[_bucket(s)], kind="stable")
                    p = min(n, n - (PERCENT * n + 99) // 100 + 1 + n // 20)
                    parts.append((s[order[:p]], np.full(p, key), np.full(p, n), held.value[_bucket(s[order[:p]])] > 0))
                if parts:
                    token, node, size, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node.astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(hot)], ["token", "node", "n", "hot"])

    return docs.select(text_of().alias("text")).mapInArrow(step, "token long, node long, n int, hot boolean")


def _linkable(rows: DataFrame) -> DataFrame:
    """(token, node, n): distinct rows of the nodes that still share ``need`` prefix tokens with others.

    A node with fewer can link with nothing, and without it others may share less, so
    this is done ROUNDS times; each round is an exact filter.
    """
    rows = staged(rows.select("token", "node", "n").distinct(), "shared")
    for _ in range(ROUNDS):
        able = rows.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n")).where(F.col("k") >= need("n")).select("node")
        left = rows.join(able, "node", "left_semi")
        shared = left.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("token")
        old, rows = rows, staged(left.join(shared, "token", "left_semi"), "shared")
        discard(old)
    return rows


def _compare(parts: DataFrame, docs: DataFrame, reps: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Links (a, b) between blocks of a group whose classes are in ``allowed``.

    parts: (g, cls, node, comp, n); pairs of the same comp, and of nodes that a task
    has joined already, are skipped.  A class of
    more than BLOCK tokens is split, so a task holds two blocks at a time, and a
    text goes to as many tasks as its class has blocks.
    """
    sizes = parts.groupBy("g", "cls").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    placed = parts.join(sizes, ["g", "cls"]).withColumn("part", F.concat_ws(":", "cls", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("string")))
    blocks = sizes.select("g", "cls", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("k")).select("g", "cls", F.concat_ws(":", "cls", F.col("k").cast("string")).alias("part"))
    two = blocks.select("g", F.col("cls").alias("c"), F.col("part").alias("x")).join(blocks.select("g", F.col("cls").alias("d"), F.col("part").alias("y")), "g")
    two = two.where((F.col("x") <= F.col("y")) & F.concat("c", "d").isin(*allowed)).withColumn("task", F.xxhash64("g", "x", "y"))
    one = F.explode(F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("part"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("x").alias("part"), F.lit(0).alias("side")), F.struct(F.col("y").alias("part"), F.lit(1).alias("side")))))
    jobs = placed.join(two.select("g", "task", one.alias("s")).select("g", "task", "s.part", "s.side"), ["g", "part"]).select("task", "side", "node", "comp")
    jobs = staged(jobs.join(reps, "node"), "jobs")
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    rows = reduced(texts, jobs.select("doc_id").distinct(), "doc_id").join(jobs, "doc_id").select("task", "side", "node", "comp", "text")
    # a node that only rows of null id have is found by its text
    nameless = texts.where(F.col("doc_id").isNull()).select("text").mapInArrow(_named, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))
    rows = rows.unionByName(nameless.join(jobs.where(F.col("doc_id").isNull()), "node").select("task", "side", "node", "comp", "text"))
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(_meet, "a long, b long")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts beside their nodes, null for those without words."""
    for batch in batches:
        keys = [_set_key(s) if len(s) else None for _, raw, offs in text_slices(batch) for s in shingle_sets(raw, offs)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("text")], ["node", "text"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each task's rows; they stand side by side, at most two blocks of them."""
    task, held = None, []
    for batch in batches:
        sets = [s for _, raw, offs in text_slices(batch) for s in shingle_sets(raw, offs)]
        rows = zip(batch.column("task").to_pylist(), batch.column("side").to_pylist(), batch.column("node").to_pylist(), batch.column("comp").to_pylist(), sets, strict=True)
        for t, side, node, comp, s in rows:
            if t != task and held:
                yield _linked(held)
                held = []
            task = t
            if _set_key(s) == node:  # another row may have the same doc_id
                held.append((node, side, comp, s))
    if held:
        yield _linked(held)


def _linked(rows: list[tuple]) -> pa.RecordBatch:
    """Links that join what the task's rows join: no more than there are components among them."""
    rows = list({(r[0], r[1]): r for r in rows}.values())
    asked, given = [r for r in rows if r[1] != 1], [r for r in rows if r[1] != 0]
    a, b = [], []
    if asked and given:
        sizes = np.array([len(r[3]) for r in given])
        tokens, owner = np.concatenate([r[3] for r in given]), np.repeat(np.arange(len(given)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        nodes = np.array([r[0] for r in given])
        label = np.unique([r[2] for r in asked + given], return_inverse=True)[1]
        theirs = label[len(asked) :]
        for k, (node, side, _, s) in enumerate(asked):
            if (theirs == label[k]).all():
                continue
            lo, hi = np.searchsorted(tokens, s, side="left"), np.searchsorted(tokens, s, side="right")
            both = np.bincount(hashing.gather(owner, lo, hi - lo), minlength=len(given))
            ok = (100 * both >= PERCENT * (len(s) + sizes - both)) & (theirs != label[k]) & ((nodes > node) | (side != 2))
            hit = np.flatnonzero(ok)
            if len(hit):
                joined, first = np.unique(theirs[hit], return_index=True)
                a += [node] * len(first)
                b += nodes[hit[first]].tolist()
                label[np.isin(label, joined)] = label[k]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): (doc_id, node, n) of every document, and links between nodes.

    The links join all nodes of a component, if not each pair in it.
    """
    first = staged(nodes_and_buckets(docs), "nodes")
    nodes = first.where(F.col("bucket").isNull()).drop("bucket")
    weights = token_order(first.where(F.col("bucket").isNotNull()))
    tokens = staged(prefix_tokens(docs, weights), "tokens")

    # tokens of more than one node: rare ones side by side, frequent ones by a pre-aggregated join
    rare, hot = tokens.where("not hot"), tokens.where("hot")
    side = Window.partitionBy("token")
    rare = rare.withColumn("lo", F.min("node").over(side)).withColumn("hi", F.max("node").over(side)).where("lo < hi").drop("lo", "hi")
    several = hot.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("token")
    rows = _linkable(rare.unionByName(hot.join(several, "token")).drop("hot"))
    discard(tokens)

    # a node's group is its most frequent token, so near copies come to few groups; the pivot is the node of least hash
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    own = rows.join(often, "token").groupBy("node").agg(F.max_by("token", F.struct("often", "token")).alias("g"), F.first("n").alias("n"))
    pivots = own.groupBy("g").agg(F.min_by("node", F.xxhash64("node")).alias("pivot"))
    own = staged(own.join(pivots, "g"), "groups")
    reps = staged(nodes.join(own.select("node"), "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "reps")
    stars = own.select("g", F.when(F.col("node") == F.col("pivot"), "P").otherwise("M").alias("cls"), "node", F.col("node").alias("comp"), "n")
    edges = staged(_compare(stars, docs, reps, ("MP", "PM")), "links")
    member = components(edges, "a", "b")
    own = own.join(member, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    own = own.join(member.select(F.col("node").alias("pivot"), F.col("component").alias("pc")), "pivot", "left").withColumn("pc", F.coalesce("pc", "pivot"))
    own = staged(own, "members")

    # the matrix: each group's token union, with the sizes of its members
    known = rows.join(own.select("node", "g", "comp"), "node")
    # a token that only one component has leads nowhere new
    mixed = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    known = staged(known.join(mixed, "token", "left_semi"), "rows")
    matrix = known.groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    matrix = matrix.select("token", F.col("g").alias("to"), "least", "most", "lo", "hi")
    met = known.join(matrix, "token").where((F.col("to") < F.col("g")) & (100 * F.col("n") >= PERCENT * F.col("least")) & (100 * F.col("most") >= PERCENT * F.col("n")))
    met = met.groupBy("node", "to").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.first("comp").alias("comp"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    met = met.where((F.col("k") >= need("n")) & ((F.col("lo") != F.col("comp")) | (F.col("hi") != F.col("comp"))))

    # opened groups
    inside = own.select("g", F.when(F.col("comp") == F.col("pc"), "R").otherwise("U").alias("cls"), "node", "comp", "n")
    heads = own.groupBy("g").agg(F.first("pc").alias("pc"))
    outside = met.select(F.col("to").alias("g"), "node", "comp", "n").join(heads, "g").select("g", F.when(F.col("comp") == F.col("pc"), "E").otherwise("F").alias("cls"), "node", "comp", "n")
    parts = staged(inside.unionByName(outside), "parts")
    live = parts.where(F.col("cls").isin("U", "F")).select("g").distinct()
    more = staged(_compare(parts.join(live, "g", "left_semi"), docs, reps, OPEN), "links")
    return nodes, edges.unionByName(more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Documents link from a Jaccard similarity of PERCENT / 100 up; component_id is the
    least doc_id that a document reaches.  Texts without words link with nothing, as
    does a null text.  Rows of one doc_id are told apart by their texts; other
    columns are not read.  A row of null doc_id links as any other and has the least
    doc_id that it reaches, null if there is none.  An empty table gives an empty result.
    """
    nodes, edges = links(docs)
    member = staged(components(edges, "a", "b"), "member")
    d = nodes.join(member, "node", "left").withColumn("g", F.coalesce("component", "node"))
    least = d.where("g is not null").groupBy("g").agg(F.min("doc_id").alias("least"))
    return d.join(least, "g", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the least doc_id (with all its rows).

    All rows of null doc_id stay: no other row can be told to stand for them.
    """
    name = fresh("_keep", docs)
    keep = near_duplicates(docs).where(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(keep, F.col("doc_id") == F.col(name), "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
