"""Exact repeats across documents by column-wise suffix sorting.

Every LENGTH-byte string has an anchor: the least-hashed GRAM-byte stretch in it.
Equal strings have equal anchors at equal places, so stretches of text around equal
anchors are the collection to sort.  All of them are aligned at the anchor and
inserted from the right, one symbol of every string a round: a round's order comes
from a stable sort of the last round's by the new symbol (the Burrows-Wheeler step),
and the common prefix of neighbours is one more than the least common prefix between
them before.  The symbols of a round are a column of a sequential file.  Neighbours
that share LENGTH symbols are repeats; the least doc_id among them keeps its copy.
Equal stretches enter the collection once, in the document of least doc_id; in any
other document such a stretch is repeated throughout.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm import hashing
from repolith.llm.common import maybe_in, reduced, staged, text_of, text_slices

LENGTH, GRAM = 50, 18
#: Places of a GRAM-byte stretch in a string.
PLACES = LENGTH - GRAM + 1
#: Strings that are sorted together, more only where they share an anchor.
COLLECTION = 200_000
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


def sums_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over bytes, and the factors that make stretches comparable."""
    n = len(raw)
    up = np.cumprod(np.concatenate([[U(1)], np.full(n, _BASE, U)]))
    down = np.cumprod(np.concatenate([[U(1)], np.full(n, _INVERSE, U)]))
    return np.concatenate([[U(0)], np.cumsum((raw.astype(U) + U(1)) * up[:-1])]), down


def grams(sums: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte stretches."""
    return hashing.mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM]) if len(sums) > GRAM else np.zeros(0, U)


def anchors(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, count, anchor, hash, stretch): runs of string starts with one anchor.

    Places are within the row; stretch is a hash of the text from the first string to the end of the last.
    """
    sums, down = sums_of(raw)
    h = grams(sums, down)
    last = len(raw) - LENGTH
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U), np.zeros(0, U))
    if last < 0:
        return none
    best, width = np.arange(len(h)), 1
    while width * 2 <= PLACES:
        a, b = best[:-width], best[width:]
        best, width = np.where(h[b] < h[a], b, a), width * 2
    a, b = best[: last + 1], best[PLACES - width : PLACES - width + last + 1]
    best = np.where(h[b] < h[a], b, a)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: last + 1]
    ok = np.arange(last + 1) + LENGTH <= offs[row + 1]
    new = ok & np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]])
    first = np.flatnonzero(new)
    if not len(first):
        return none
    count = np.add.reduceat(ok.astype(np.int64), first)
    r, m = row[first], best[first]
    whole = hashing.mix((sums[first + count + LENGTH - 1] - sums[first]) * down[first] + count.astype(U))
    return r, first - offs[r], count, m - offs[r], h[m], whole


#: Arrays of a packed row: four hash bytes, eight of the stretch's, document (as differences), row (0 but for repeated ids), place, back and count.
_KINDS = (("h", np.uint32), ("s", np.uint32), ("t", np.uint32), ("doc", np.int64), ("row", np.int64), ("m", np.int32), ("back", np.int8), ("n", np.int8))


def _spread(docs: DataFrame, shards: int) -> DataFrame:
    """Per batch and shard a row of anchors, packed and compressed."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, own = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
            parts = []
            for at, raw, offs in text_slices(batch):
                r, start, count, m, h, whole = anchors(raw, offs)
                parts.append((h, whole, ids[at + r], own[at + r], m, m - start, count))
            h, whole, doc, row, m, back, count = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, U)] * 7
            if len(h):
                shard = (h >> U(40)).astype(np.int64) % shards
                order = np.argsort(shard, kind="stable")
                bounds = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0, [True]]))
                x = {"h": h, "s": whole, "t": whole >> U(32), "doc": doc, "row": row, "m": m, "back": back, "n": count}
                cols = [x[k][order].astype(t) for k, t in _KINDS]
                rows = []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    packed = [np.diff(c[a:b], prepend=0) if k == "doc" else c[a:b] for (k, _), c in zip(_KINDS, cols, strict=True)]
                    rows.append(press.compress(b"".join(c.tobytes() for c in packed)))
                yield pa.RecordBatch.from_arrays([pa.array(shard[order][bounds[:-1]], pa.int32()), pa.array(np.diff(bounds), pa.int64()), pa.array(rows, pa.binary())], ["shard", "size", "packed"])

    return docs.mapInArrow(step, "shard int, size long, packed binary")


def _met(rows: DataFrame) -> DataFrame:
    """(doc_id, row, m, back, n, whole) of anchors whose hash occurs in several documents.

    whole: a document of smaller doc_id has the same stretch.  Of the others only
    those stay whose anchor has several stretches.
    """

    def done(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        press, parts = zstandard.ZstdDecompressor(), []
        for size, packed in held:
            data, at, one = press.decompress(packed), 0, {}
            for k, t in _KINDS:
                one[k] = np.frombuffer(data, t, size, at)
                at += size * np.dtype(t).itemsize
            parts.append(one | {"doc": np.cumsum(one["doc"])})
        x = {k: np.concatenate([p[k] for p in parts]) for k, _ in _KINDS}
        stretch = x["s"].astype(U) | x["t"].astype(U) << U(32)
        order = np.lexsort((stretch, x["h"]))
        h, stretch, doc = x["h"][order], stretch[order], x["doc"][order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        inner = new | np.concatenate([[True], stretch[1:] != stretch[:-1]])
        first, second = np.flatnonzero(new), np.flatnonzero(inner)
        spread = lambda values, at: np.repeat(values, np.diff(np.append(at, len(h))))
        several = spread((np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)) & (np.add.reduceat(inner.astype(np.int64), first) > 1), first)
        whole = doc > spread(np.minimum.reduceat(doc, second), second)
        on = np.flatnonzero(whole | several)
        at = order[on]
        return pa.RecordBatch.from_arrays([pa.array(doc[on]), pa.array(x["row"][at]), *(pa.array(x[k][at].astype(np.int32)) for k in ("m", "back", "n")), pa.array(whole[on])], ["doc_id", "row", "m", "back", "n", "whole"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard and held:
                    yield done(held)
                    held = []
                shard = r["shard"]
                held.append((r["size"], r["packed"]))
        if held:
            yield done(held)

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(step, "doc_id long, row long, m int, back int, n int, whole boolean")


def _contexts(rows: DataFrame) -> DataFrame:
    """(h, doc_id, row, m, back, n, string): the text around each anchor, from its first string to the end of its last."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found")
            begin = lists.offsets.to_numpy()
            flat = lists.flatten()
            m, back, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("m", "back", "n"))
            at0 = begin[0]
            for at, raw, offs in text_slices(batch):
                rows = len(offs) - 1
                a, b = begin[at] - at0, begin[at + rows] - at0
                owner = np.repeat(np.arange(rows), np.diff(begin[at : at + rows + 1]))
                k = np.arange(a, b)
                place = offs[owner] + m[k]
                size = n[k] + LENGTH - 1
                data = hashing.gather(raw, place - back[k], size)
                h = grams(*sums_of(raw))[place] if len(place) else np.zeros(0, U)
                strings = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                ids = [batch.column(c).take(pa.array(at + owner)) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *ids, *(pa.array(x[k].astype(np.int32)) for x in (m, back, n)), strings], ["h", "doc_id", "row", "m", "back", "n", "string"])

    return rows.mapInArrow(step, "h long, doc_id long, row long, m int, back int, n int, string binary")


class Minima:
    """Least value between two places of an array, from minima over powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            x, w = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(x[:-w], x[w:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """min(values[lo:hi]) for hi > lo."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for k in np.unique(level):
            on = np.flatnonzero(level == k)
            out[on] = np.minimum(self.levels[k][lo[on]], self.levels[k][hi[on] - (1 << int(k))])
        return out


def sort_columns(strings: np.ndarray, begins: np.ndarray, sizes: np.ndarray, back: np.ndarray, count: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each string the places, as bits from its first on, whose LENGTH-byte strings also start in a smaller document.

    ``strings`` holds them one after another; ``back`` is where a string's anchor is.
    """
    n = len(begins)
    left, right = int(back.max()), int((sizes - back).max())
    flags = np.zeros(n, np.int64)
    with tempfile.TemporaryFile() as file:
        for c in range(right - 1, -left - 1, -1):
            at = back + c
            on = (at >= 0) & (at < sizes)
            file.write(np.where(on, strings[np.minimum(begins + np.clip(at, 0, sizes - 1), len(strings) - 1)].astype(np.int16) + 1, 0).astype("<i2").tobytes())
        file.seek(0)
        order, lcp = np.arange(n), np.zeros(n, np.uint8)
        for c in range(right - 1, -left - 1, -1):
            symbol = np.frombuffer(file.read(2 * n), "<i2")[order]
            move = np.argsort(symbol, kind="stable")
            new = np.zeros(n, np.uint8)
            s = symbol[move]
            same = np.flatnonzero((s[1:] == s[:-1]) & (s[1:] > 0))
            if len(same):
                new[same + 1] = np.minimum(Minima(lcp).between(move[same] + 1, move[same + 1] + 1), LENGTH) + 1
            order, lcp = order[move], np.minimum(new, LENGTH)
            at = (back + c)[order]
            ask = (at >= 0) & (at < count[order])
            if not ask.any():
                continue
            first = np.flatnonzero(lcp < LENGTH)
            owner = np.where(ask, doc[order], np.iinfo(np.int64).max)
            least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, n)))
            hit = np.flatnonzero(ask & (least < doc[order]))
            flags[order[hit]] |= np.int64(1) << at[hit]
    return flags


def _sorted(rows: DataFrame) -> DataFrame:
    """(doc_id, row, start, bits) of strings with repeats; all strings of an anchor are in one collection."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        col = t.column("string").cast(pa.large_binary())
        begins = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        raw = np.frombuffer(col.buffers()[2], np.uint8)
        doc, row, m, back, n = (t.column(k).to_numpy() for k in ("doc_id", "row", "m", "back", "n"))
        flags = sort_columns(raw, begins[:-1], np.diff(begins), back.astype(np.int64), n.astype(np.int64), doc)
        on = np.flatnonzero(flags)
        return pa.RecordBatch.from_arrays([pa.array(doc[on]), pa.array(row[on]), pa.array((m - back)[on]), pa.array(flags[on])], ["doc_id", "row", "start", "bits"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, None
        for batch in batches:
            h = batch.column("h").to_numpy()
            if not len(h):
                continue
            if rows >= COLLECTION:
                cut = int(np.argmax(h != last)) if (h != last).any() else len(h)
                if cut < len(h):
                    if cut:
                        held.append(batch.slice(0, cut))
                    yield done(held)
                    held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows, last = rows + len(batch), h[-1]
        if held:
            yield done(held)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(step, "doc_id long, row long, start int, bits long")


def _covered(size: int, starts: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which bytes of a text are covered by its repeated strings."""
    k, place = np.nonzero((bits[:, None] >> np.arange(PLACES)) & 1)
    at = starts[k] + place
    at = at[at + LENGTH <= size]
    edge = np.bincount(at, minlength=size + 1) - np.bincount(at + LENGTH, minlength=size + 1)
    return np.cumsum(edge)[:size] > 0


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row, with the bytes that are left.

    A byte goes if a LENGTH-byte string over it also starts in a document of smaller
    doc_id.  Null and empty texts have no bytes; shorter texts and rows of null
    doc_id keep all theirs, and rows of one doc_id don't count against each other.
    Only doc_id and text are read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    # rows of one doc_id are told apart by a hash of their texts
    repeated = staged(own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "repeated")
    own = maybe_in(own, repeated, "doc_id", "_several").select("doc_id", "text", F.when(F.col("_several"), F.xxhash64("text")).otherwise(0).alias("row"))
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = staged(_met(_spread(own.where("doc_id is not null"), shards)), "anchors")
    ask = found.where("not whole")
    lists = ask.groupBy("doc_id", "row").agg(F.collect_list(F.struct("m", "back", "n")).alias("found"))
    strings = _contexts(reduced(own, ask.select("doc_id"), "doc_id").join(lists, ["doc_id", "row"]).select("doc_id", "row", "text", "found"))
    every = found.where("whole").select("doc_id", "row", (F.col("m") - F.col("back")).alias("start"), (F.expr("shiftleft(1L, n)") - 1).alias("bits"))
    bits = staged(_sorted(strings), "repeats").unionByName(every)
    lists = bits.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "bits")).alias("found"))
    hit = reduced(own, bits.select("doc_id"), "doc_id").join(lists, ["doc_id", "row"], "left").drop("row")
    rest = reduced(own, bits.select("doc_id"), "doc_id", rest=True).drop("row").withColumn("found", F.lit(None).cast(hit.schema["found"].dataType))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists = batch.column("found")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            starts, bits = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "bits"))
            for at, raw, offs in text_slices(batch):
                for k in range(len(offs) - 1):
                    one, mine = raw[offs[k] : offs[k + 1]], slice(ends[at + k], ends[at + k + 1])
                    gone = _covered(len(one), starts[mine], bits[mine])
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    out.append((len(one), int(gone.sum()), spans, one[~gone].tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return hit.unionByName(rest).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
