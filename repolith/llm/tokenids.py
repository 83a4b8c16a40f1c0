"""Token ids in order of doc_id, stored as byte planes, and read back.

A chunk is a row of a Parquet table: the ids of some whole documents, in blocks of
BLOCK ids.  A block is transposed into four byte planes (the low bytes of all ids,
then the next ones), each compressed with zstandard; the chunk's index holds the
compressed size of every plane, so a block can be read without those before it.
Chunks number the ids before them within their part, parts follow the order of
doc_id, and a table of part totals gives every document its global start.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm import hashing
from repolith.llm.common import staged, text_of, text_slices

BLOCK = 1 << 14
PLANES = 4
#: A chunk ends after the document that brings it to so many ids.
CHUNK = 1 << 18
END = 2
#: Units whose ids a worker remembers, and how many ids; forgotten all at once beyond either, which costs time only.
REMEMBERED = 1_500_000
REMEMBERED_IDS = 1 << 23
#: Text bytes encoded at once.
SLICE = 1 << 21
#: Bytes of new units that the tokenizer gets as one text.
JOINED = 1 << 17
CHUNK_SCHEMA = "part int, seq int, first long, doc_ids array<long>, sizes array<long>, planes binary, plane_sizes array<int>"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Encoder:
    """Ids of whole texts, unit by unit: white space and the word after it, or marks after a word.

    The vocabulary's splitting never joins a word to the white space or marks behind it,
    so a unit has the same ids alone as within its text; equal units are encoded once,
    many of them in one call.  A row with an added token of the file in it is encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the vocabulary writes each byte as one character; added tokens are as they stand
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.widths = np.zeros(max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1, np.int64)
        self.widths[list(vocab.values())] = [len(x) for x in vocab]
        for k, t in self.tokenizer.get_added_tokens_decoder().items():
            self.widths[k] = len(t.content.encode())
        self._forget()

    def _forget(self) -> None:
        """Start with no unit: their hashes in order, where the ids of each begin, and how many it has."""
        self.known, self.begins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Where ``ids`` begin among those remembered, once they are added."""
        at = self.used
        while len(self.ids) < at + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _singly(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of units begin and how many each has: each unit is a text of its own."""
        texts = [raw[a:b].tobytes().decode() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in encoded], np.int64)
        ids = np.fromiter((i for x in encoded for i in x), np.uint32, int(sizes.sum()))
        return self._keep(ids) + np.cumsum(sizes) - sizes, sizes

    def _joined(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_singly`` of units whose last character is no white space, in one text.

        A line break goes before a unit that does not begin with white space.  The
        bytes of the ids tell which are whose; where a unit does not begin and end
        with an id, the units are encoded singly.
        """
        sizes = stops - starts
        ends = np.cumsum(sizes + ~hashing.is_space(raw[starts]))
        text = np.full(int(ends[-1]), 0x0A, np.uint8)
        text[np.arange(int(sizes.sum())) + np.repeat(ends - np.cumsum(sizes), sizes)] = hashing.gather(raw, starts, sizes)
        [found] = self.tokenizer.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        places = np.concatenate([[0], np.cumsum(self.widths[ids])])
        a, b = np.searchsorted(places, ends - sizes), np.searchsorted(places, ends)
        if places[-1] != len(text) or (places[a] != ends - sizes).any() or (places[b] != ends).any():
            return self._singly(raw, starts, stops)
        return self._keep(ids) + a, b - a

    def _learn(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new units begin and how many each has."""
        begins, sizes = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        solid = hashing.ends_solid(raw, stops)
        rest = np.flatnonzero(~solid)
        if len(rest):
            begins[rest], sizes[rest] = self._singly(raw, starts[rest], stops[rest])
        solid = np.flatnonzero(solid)
        turns = np.cumsum(stops[solid] - starts[solid]) // JOINED
        for k in np.split(solid, np.flatnonzero(np.diff(turns)) + 1):
            if len(k):
                begins[k], sizes[k] = self._joined(raw, starts[k], stops[k])
        return begins, sizes

    def _with_added(self, data: bytes, offs: np.ndarray) -> list[int]:
        """Rows that hold an added token."""
        out = set()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                k = int(np.searchsorted(offs, at, side="right")) - 1
                if at + len(token) <= offs[k + 1]:
                    out.add(k)
                    at = data.find(token, int(offs[k + 1]))
                else:
                    at = data.find(token, at + 1)
        return sorted(out)

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, how many each row has), without end ids."""
        data = raw.tobytes()
        whole = self._with_added(data, offs)
        if len(offs) == 2:  # a long text goes stretch by stretch
            places = hashing.cuts(raw, SLICE)
            parts = [self._by_units(raw[a:b], np.array([0, b - a]))[0] for a, b in zip(places[:-1], places[1:], strict=True)]
            ids = np.concatenate(parts)
            sizes = np.array([len(ids)])
        else:
            ids, sizes = self._by_units(raw, offs)
        if not whole:
            return ids, sizes
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for k in whole:
            parts[k] = np.array(self.tokenizer.encode(data[offs[k] : offs[k + 1]].decode(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _by_units(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of rows without added tokens."""
        hashes, starts, rows = hashing.units(raw, offs, marks=True)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        distinct, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED or self.used > REMEMBERED_IDS:
            self._forget()
        slots = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        near = np.flatnonzero(slots < len(self.known))
        new[near] = self.known[slots[near]] != distinct[near]
        if new.any():
            begins, sizes = self._learn(raw, starts[first[new]], np.append(starts[1:], len(raw))[first[new]])
            known, begins, sizes = (np.insert(held, slots[new], x) for held, x in ((self.known, distinct[new]), (self.begins, begins), (self.sizes, sizes)))
            self.known, self.begins, self.sizes = known, begins, sizes
            slots += np.cumsum(new) - new
        at = slots[unit]
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return hashing.gather(self.ids, self.begins[at], sizes), np.diff(ends[rows])


@lru_cache(maxsize=1)
def encoder_of(path: str, run: str) -> Encoder:
    """A worker's encoder: what it has learned serves the tasks that follow in one run, and no other run."""
    return Encoder(path)


def pack(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """Byte planes of blocks of ids, compressed, and the size of each plane."""
    press, out = zstandard.ZstdCompressor(level=1), []
    for a in range(0, len(ids), BLOCK):
        planes = np.ascontiguousarray(ids[a : a + BLOCK].astype("<u4").view(np.uint8).reshape(-1, PLANES).T)
        out += [press.compress(p.tobytes()) for p in planes]
    return b"".join(out), [len(x) for x in out]


def unpack(data: bytes, sizes: list[int]) -> np.ndarray:
    """The ids that ``pack`` was given."""
    press, ends = zstandard.ZstdDecompressor(), np.cumsum([0, *sizes])
    parts = []
    for k in range(0, len(sizes), PLANES):
        planes = [np.frombuffer(press.decompress(data[ends[k + j] : ends[k + j + 1]]), np.uint8) for j in range(PLANES)]
        parts.append(np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel())
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Chunks (CHUNK_SCHEMA) of the ids of all rows in ascending order of key, END after each.

    Null and empty texts have only the end id; null keys come first; rows of equal
    keys follow each other in the order of their texts.  An empty table has no chunks.
    The rows are range-partitioned by key, so no task holds more than its share.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    run = uuid.uuid4().hex

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, first = encoder_of(path, run), TaskContext.get().partitionId(), 0, 0
        keys: list = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        total = 0

        def chunk() -> pa.RecordBatch:
            data, sizes = pack(np.concatenate(held))
            row = {"part": part, "seq": seq, "first": first, "doc_ids": keys, "sizes": counts, "planes": data, "plane_sizes": sizes}
            kinds = {"part": pa.int32(), "seq": pa.int32(), "first": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "planes": pa.binary(), "plane_sizes": pa.list_(pa.int32())}
            return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in kinds.items()], list(kinds))

        for batch in batches:
            ids_of = batch.column("key").to_pylist()
            for at, raw, offs in text_slices(batch, limit=SLICE):
                ids, sizes = encoder.encode(raw, offs)
                ends = np.cumsum(sizes)
                for k in range(len(sizes)):
                    held += [ids[ends[k] - sizes[k] : ends[k]], np.array([END], np.uint32)]
                    keys.append(ids_of[at + k])
                    counts.append(int(sizes[k]) + 1)
                    total += int(sizes[k]) + 1
                    if total >= CHUNK:
                        yield chunk()
                        seq, first = seq + 1, first + total
                        keys, counts, held, total = [], [], [], 0
        if keys:
            yield chunk()

    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    return rows.repartitionByRange(n, "key").sortWithinPartitions("key", "text").mapInArrow(step, CHUNK_SCHEMA)


def read(chunks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from its chunk."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["planes"], r["plane_sizes"])
                ends = np.cumsum(r["sizes"])
                data = ids.tobytes()
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), r["sizes"], strict=True)]
                k = len(crcs)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * k, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["first"] + ends - np.array(r["sizes"])), pa.array(r["sizes"], pa.int64()), pa.array(crcs, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    totals = chunks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # a row for each part of the range partitioning: a few thousand at most
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    docs = chunks.mapInArrow(step, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, path: str) -> DataFrame:
    """``read`` of the chunks of ``docs``, once they are written to the shared folder."""
    return read(staged(encode(docs, path), "token-ids"))
