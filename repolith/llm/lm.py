"""Scores of texts under a bigram model held in a log-frequency Bloom filter.

Counts are quantised to powers of two: an n-gram seen c times is put in the filter
as (n-gram, 1) ... (n-gram, 1 + floor(log2 c)).  A lookup probes level after level
until one is missing.  The filter is cut into shards by hash; a task of the build
has one shard's n-grams, and all of them, whatever the size of the corpus.  Below
BROADCAST_BYTES the shards are broadcast.  A larger filter stays in the shared folder:
a slice of texts sends each shard one row of the distinct n-grams that it needs, 8
bytes each, and gets one row of levels back, a byte each, in turns of a part of the slices.  The n-grams that nearly
every slice needs are at most FREQUENT and are broadcast with their levels.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import hashing
from repolith.llm.common import discard, staged, text_of, text_slices

U = np.uint64
#: Bits for each (n-gram, level) and probes for each; about 2 false hits in 100.
BITS, PROBES, LEVELS = 8, 5, 40
#: N-grams a shard is planned for.
SHARD = 1 << 20
#: Largest filter that is broadcast; measured up to 67 MB, which takes a driver of 1.3 GB.
BROADCAST_BYTES = 96 << 20
#: Most frequent words whose exact counts are broadcast (16 bytes each); the rest is joined.
#: Also the most n-grams whose levels are broadcast beside a filter that is not.
FREQUENT = 1 << 17
#: Turns in which slices ask a filter that is not broadcast; the files of one turn's shuffles go before the next.
ROUNDS = 4
#: Weight of the unigram distribution in the bigram's (Dirichlet smoothing).
MU = 200.0
#: Groups of neighbouring shards that a slice asks, at least, where there are so many shards; and n-grams looked up at once.
GROUPS, LOOKUPS = 64, 1 << 19
END = np.array([0xE17A146562656769], U)


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's lower-cased words and an end, and where rows begin."""
    words, bounds = hashing.words(raw, offs)
    out = np.insert(words, bounds[1:], END)
    return out, bounds + np.arange(len(bounds))


def bigrams(toks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; a row's first token follows an end."""
    before = np.concatenate([END, toks[:-1]])
    before[bounds[:-1]] = END
    return hashing.mix(before * U(0x9FB21C651E98DF25) + hashing.mix(toks))


def _packed(docs: DataFrame, shards: int) -> DataFrame:
    """Per batch and shard, a row of distinct n-gram hashes with their counts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0, U)]
            for _, raw, offs in text_slices(batch):
                t, b = tokens(raw, offs)
                parts += [t, bigrams(t, b)]
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            if len(h):
                shard = (h >> U(40)).astype(np.int64) % shards
                order = np.argsort(shard, kind="stable")
                h, c, shard = h[order], c[order].astype(np.uint32), shard[order]
                cut = np.flatnonzero(np.diff(shard)) + 1
                hs, cs = np.split(h, cut), np.split(c, cut)
                yield pa.RecordBatch.from_arrays([pa.array(shard[np.concatenate([[0], cut])], pa.int32()), pa.array([x.tobytes() for x in hs], pa.binary()), pa.array([x.tobytes() for x in cs], pa.binary())], ["shard", "hashes", "counts"])

    return docs.select(text_of().alias("text")).mapInArrow(step, "shard int, hashes binary, counts binary")


def places(h: np.ndarray, level: np.ndarray | int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit places of (n-gram, level) in a shard of so many bits."""
    x = hashing.mix(h + U(0xA0761D6478BD642F) * np.asarray(level, U))
    step = hashing.mix(x) | U(1)
    for _ in range(PROBES):
        yield (x % np.asarray(bits, U)).astype(np.int64)
        x = x + step


def _merged(hashes: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a shard, ascending, and their exact counts."""
    h = np.concatenate([np.frombuffer(x, U) for x in hashes])
    c = np.concatenate([np.frombuffer(x, np.uint32) for x in counts]).astype(np.int64)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(c, first)


def _bits(h: np.ndarray, c: np.ndarray) -> bytes:
    levels = 1 + np.floor(np.log2(c)).astype(np.int64)
    size = 64 * (1 + int(levels.sum()) * BITS // 64)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max()) + 1):
        for p in places(h[levels >= level], level, size):
            bits[p] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _shard_bits(hashes: list[bytes], counts: list[bytes]) -> bytes:
    return _bits(*_merged(hashes, counts))


def _shard(hashes: list[bytes], counts: list[bytes], heavy_from: float) -> tuple[bytes, bytes, bytes]:
    """Bits of a shard, its n-grams with ``heavy_from`` counts or more, and the levels that the bits give these."""
    h, c = _merged(hashes, counts)
    bits, heavy = _bits(h, c), h[c >= heavy_from]
    return bits, heavy.tobytes(), Filter([(0, bits)], 1).levels(heavy).astype(np.uint8).tobytes()


def build(docs: DataFrame, shards: int, heavy_from: float = float("inf")) -> DataFrame:
    """(shard, bits, heavy, levels) of the filter over all rows of ``docs``; heavy: n-grams counted so often or more."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        done = lambda k: pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in _shard(*held.pop(k), heavy_from))], ["shard", "bits", "heavy", "levels"])
        for batch in batches:
            for k, h, c in zip(*(batch.column(x).to_pylist() for x in ("shard", "hashes", "counts")), strict=True):
                if held and k not in held:
                    yield done(next(iter(held)))
                one = held.setdefault(k, ([], []))
                one[0].append(h)
                one[1].append(c)
        if held:
            yield done(next(iter(held)))

    return _packed(docs, shards).repartition("shard").sortWithinPartitions("shard").mapInArrow(step, "shard int, bits binary, heavy binary, levels binary")


class Filter:
    """Shards of the filter laid side by side."""

    def __init__(self, rows: Iterable[tuple[int, bytes]], shards: int, octets: dict[int, int] | None = None):
        """octets: the shards' sizes, with which ``rows`` may come one by one."""
        self.shards = shards
        sizes = np.ones(shards, np.int64) * 8
        for k, size in (octets or {k: len(b) for k, b in rows}).items():
            sizes[k] = 8 * size
        self.bits, self.first = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.zeros(int(self.first[-1]) // 8, np.uint8)
        for k, b in rows:
            self.data[self.first[k] // 8 : self.first[k + 1] // 8] = np.frombuffer(b, np.uint8)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram's quantised count, 0 where level 1 is missing."""
        level, left = np.zeros(len(h), np.int64), np.arange(len(h))
        for k in range(1, LEVELS):
            x = h[left]
            shard = (x >> U(40)).astype(np.int64) % self.shards
            hit = np.ones(len(left), bool)
            for p in places(x, k, self.bits[shard]):
                at = p + self.first[shard]
                hit &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            left = left[hit]
            level[left] = k
            if not len(left):
                break
        return level

    def counts(self, h: np.ndarray) -> np.ndarray:
        return middle(self.levels(h))


def middle(level: np.ndarray) -> np.ndarray:
    """Middle of the counts that a level stands for."""
    return np.where(level > 0, np.exp2(level - 1.0) * np.where(level > 1, 1.42, 1.0), 0.0)


def log_probs(pair: np.ndarray, one: np.ndarray, before: np.ndarray, n: float, v: float) -> np.ndarray:
    """log10 of smoothed probabilities from counts of the bigram, its token and the token before."""
    uni = (one + 1.0) / (n + v + 1.0)
    return np.log10((np.minimum(pair, np.minimum(one, before)) + MU * uni) / (before + MU))


def score(docs: DataFrame, training: Column, key: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, train_types, base_score, score) for each row of ``docs``.

    The model learns from the rows where ``training`` holds.  Null and empty texts
    are one end token.  base_score uses exact unigram counts; score is the bigram
    model's log10 probability.  Rows of equal keys keep their own rows; without
    training rows every count is 0.  Other columns are not read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(key).cast("long").alias("doc_id"), text_of().alias("text"), training.alias("train"))
    train = d.where("train")
    words = staged(_counts(train), "words")
    total = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])

    # exact counts of the most frequent words, as many as FREQUENT holds; a step for each eighth of a power of two
    steps = words.groupBy(F.floor(8 * F.log2("c")).alias("s")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("s")).collect()
    least, room = float("inf"), FREQUENT
    for r in steps:
        room -= r["k"]
        if room < 0:
            break
        least = r["s"]
    top = words.where(F.floor(8 * F.log2("c")) >= least).orderBy("h").collect() if steps and least < float("inf") else []
    frequent = spark.sparkContext.broadcast((np.array([r["h"] for r in top], np.int64), np.array([r["c"] for r in top], np.int64)))

    shards = max(1, -(-n // SHARD))
    lfbf = staged(build(train, shards, max(2.0, 2 * n / FREQUENT)), "filter")
    size = lfbf.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    small = size <= broadcast_bytes
    octets = dict(lfbf.select("shard", F.octet_length("bits")).collect()) if small else {}
    held = spark.sparkContext.broadcast(Filter(((r["shard"], r["bits"]) for r in lfbf.select("shard", "bits").toLocalIterator()), shards, octets) if small else None)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fh, fc = frequent.value
        for number, batch in enumerate(batches):
            for at, raw, offs in text_slices(batch):
                t, b = tokens(raw, offs)
                distinct, which = np.unique(t, return_inverse=True)
                signed = distinct.view(np.int64)
                k = np.minimum(np.searchsorted(fh, signed), max(0, len(fh) - 1))
                hit = fh[k] == signed if len(fh) else np.zeros(len(signed), bool)
                exact = np.where(hit, fc[k] if len(fh) else 0, 0)
                if small:
                    pairs = bigrams(t, b)
                    one = held.value.counts(distinct)[which]
                    before = np.concatenate([[0.0], one[:-1]])
                    before[b[:-1]] = held.value.counts(END)[0]
                    score = np.add.reduceat(log_probs(held.value.counts(pairs), one, before, n, v), b[:-1])
                else:
                    score = np.zeros(len(b) - 1)
                base = np.where(hit[which], np.log10((exact[which] + 1.0) / (n + v + 1.0)), 0.0)
                rows = len(b) - 1
                # the first row of a slice carries all its words, where they are yet to be scored
                carried = [[None] * rows] * 3 if small else [[x.tobytes()] + [None] * (rows - 1) for x in (distinct, which.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32), b)]
                # words that are not frequent go out as (text number, word, count)
                rare = np.flatnonzero(~hit[which])
                owner = np.searchsorted(b, rare, side="right") - 1
                pair = np.unique(np.stack([owner, which[rare]], axis=1), axis=0, return_counts=True) if len(rare) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * rows, pa.int64()),
                        pa.array(at + np.arange(rows)),
                        batch.column("doc_id").slice(at, rows).cast(pa.int64()),
                        pa.array(np.diff(b)),
                        pa.array(np.add.reduceat(hit[which].astype(np.int64), b[:-1])),
                        pa.array(np.add.reduceat(base, b[:-1])),
                        pa.array(score),
                        _lists(distinct.view(np.int64)[pair[0][:, 1]], pair[0][:, 0], rows),
                        _lists(pair[1].astype(np.int64), pair[0][:, 0], rows),
                        *(pa.array(x, pa.binary()) for x in carried),
                    ],
                    ["batch", "row", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "times", "words", "which", "bounds"],
                )

    schema = "batch long, row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<long>, times array<long>, words binary, which binary, bounds binary"
    # a task reads far fewer than 2 ** 20 batches, and a batch holds fewer rows
    out = d.select("doc_id", "text").mapInArrow(step, schema).withColumn("id", F.shiftleft(F.shiftleft(F.spark_partition_id().cast("long"), 20) + F.col("batch"), 20) + F.col("row"))
    out = base = staged(out, "scores")
    rare = out.select("id", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("id", F.col("x.rare").alias("h"), F.col("x.times").alias("k"))
    got = rare.join(words, "h", "left").select("id", "k", F.coalesce("c", F.lit(0)).alias("c"))
    got = got.groupBy("id").agg(F.sum(F.col("k") * F.log10((F.col("c") + 1.0) / F.lit(n + v + 1.0))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("also"))
    out = out.join(got, "id", "left")
    parts = []
    if not small:
        released(spark)
        for k in range(ROUNDS):
            turn = F.pmod(F.xxhash64("id"), F.lit(ROUNDS)) == k
            parts.append(staged(_shuffled(base.where(turn), lfbf, shards, n, v), "part"))
            released(spark)
        scores = parts[0]
        for x in parts[1:]:
            scores = scores.unionByName(x)
        out = out.drop("score").join(scores, "id")
    full = out.select("id", "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.lit(v).cast("long").alias("train_types"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
    full = staged(full.drop("id"), "lm")
    discard(words, lfbf, base, *parts)
    return full


def _wanted(toks: np.ndarray, bounds: np.ndarray, heavy: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a slice that are not among the ascending ``heavy``, by shard and hash, and their shards."""
    h = np.unique(np.concatenate([toks, bigrams(toks, bounds)]))
    if len(heavy):
        h = h[heavy[np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)] != h]
    shard = (h >> U(40)).astype(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    return h[order], shard[order]


def released(spark: SparkSession) -> None:
    """Let the driver's JVM look for garbage, as files of shuffles stay until it has found that nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _shuffled(texts: DataFrame, lfbf: DataFrame, shards: int, n: int, v: int) -> DataFrame:
    """(id, score) with the filter left in shards: requests of slices go to the shards, levels come back.

    Rows stream past the one group of shards, and past the one slice, that a task holds, so its
    memory does not grow with the requests.  The groups are fewer than twice ``GROUPS``, so requests
    grow with the slices, not with slices times shards, and those of many slices are looked up at once.  An n-gram that is not heavy is in at most
    one of 65536 tokens.
    """
    each = max(1, shards // GROUPS)
    top = lfbf.where(F.octet_length("heavy") > 0).select("heavy", "levels").collect()
    h = np.frombuffer(b"".join(r["heavy"] for r in top), U)
    q = np.frombuffer(b"".join(r["levels"] for r in top), np.uint8)
    order = np.argsort(h)
    heavy = texts.sparkSession.sparkContext.broadcast((h[order], q[order]))

    def read(words: bytes, which: bytes, bounds: bytes) -> tuple[np.ndarray, np.ndarray]:
        distinct = np.frombuffer(words, U)
        return distinct[np.frombuffer(which, np.uint16 if len(distinct) <= 1 << 16 else np.uint32)], np.frombuffer(bounds, np.int64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, shard = _wanted(*read(r["words"], r["which"], r["bounds"]), heavy.value[0], shards)
                if len(h):
                    group = shard // each
                    cut = np.flatnonzero(np.diff(group)) + 1
                    at = np.concatenate([[0], cut])
                    yield pa.RecordBatch.from_arrays([pa.array(group[at], pa.int32()), pa.array([r["id"]] * len(at), pa.int64()), pa.array([None] * len(at), pa.int32()), pa.array([x.tobytes() for x in np.split(h, cut)], pa.binary())], ["group", "slice", "shard", "data"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bits, held, asked, size = None, [], None, [], 0

        def done() -> pa.RecordBatch:
            nonlocal held, asked, size
            held = held or Filter(bits, shards)
            parts = [np.frombuffer(x, U) for _, x in asked]
            levels = held.levels(np.concatenate(parts)).astype(np.uint8)
            replies = [x.tobytes() for x in np.split(levels, np.cumsum([len(x) for x in parts])[:-1])]
            out = pa.RecordBatch.from_arrays([pa.array([group] * len(asked), pa.int32()), pa.array([k for k, _ in asked], pa.int64()), pa.array(replies, pa.binary())], ["shard", "slice", "levels"])
            asked, size = [], 0
            return out

        # a group's shards come before its requests
        for batch in batches:
            for g, part, k, data in zip(*(batch.column(c) for c in ("group", "slice", "shard", "data")), strict=True):
                if g.as_py() != group:
                    if asked:
                        yield done()
                    group, bits, held = g.as_py(), [], None
                if part.is_valid:
                    asked.append((part.as_py(), data.as_py()))
                    size += len(asked[-1][1]) // 8
                    if size >= LOOKUPS:
                        yield done()
                else:
                    bits.append((k.as_py(), data.as_py()))
        if asked:
            yield done()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_levels = heavy.value
        work, got = None, []

        def done() -> pa.RecordBatch:
            t, b = read(work["words"], work["which"], work["bounds"])
            h = np.concatenate([known, _wanted(t, b, known, shards)[0]])
            q = np.concatenate([known_levels, *(np.frombuffer(x, np.uint8) for x in got)])
            order = np.argsort(h)
            h, counts = h[order], middle(q[order].astype(np.int64))
            one = counts[np.searchsorted(h, t)]
            before = np.concatenate([[0.0], one[:-1]])
            before[b[:-1]] = counts[np.searchsorted(h, END)]
            score = np.add.reduceat(log_probs(counts[np.searchsorted(h, bigrams(t, b))], one, before, n, v), b[:-1])
            return pa.RecordBatch.from_arrays([pa.array(work["slice"] + np.arange(len(score))), pa.array(score)], ["id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["levels"] is not None:
                    got.append(r["levels"])
                    continue
                if work:
                    yield done()
                work, got = r, []
        if work:
            yield done()

    work = texts.where("words is not null").select(F.col("id"), "words", "which", "bounds")
    requests = work.mapInArrow(ask, "group int, slice long, shard int, data binary")
    asked = lfbf.select(F.floor(F.col("shard") / each).cast("int").alias("group"), F.lit(None).cast("long").alias("slice"), "shard", F.col("bits").alias("data")).union(requests)
    replies = asked.repartition("group").sortWithinPartitions("group", F.col("slice").asc_nulls_first()).mapInArrow(look, "shard int, slice long, levels binary")
    both = work.withColumnRenamed("id", "slice").unionByName(replies, allowMissingColumns=True)
    # a slice's own row, without a shard, comes before its replies
    return both.repartition("slice").sortWithinPartitions("slice", F.col("shard").asc_nulls_first()).mapInArrow(finish, "id long, score double")


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    """Values as a list for each of so many rows; owner is ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), pa.array(values))


def _counts(docs: DataFrame) -> DataFrame:
    """(h, c): exact counts of all tokens, added up in each batch before the shuffle."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = np.unique(np.concatenate([np.zeros(0, U), *(tokens(raw, offs)[0] for _, raw, offs in text_slices(batch))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return docs.select(text_of().alias("text")).mapInArrow(step, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
