"""Sampled SentencePiece segmentations by forward filtering, backward sampling.

The lattice of a text has an edge for each piece that matches at each byte.  No
piece crosses from other characters into white space, so the lattice falls into
units (white space and the word after it), and units that occur often are filtered
once a slice.  Forward messages go up the lattice by column for all units at once;
then all occurrences are sampled backwards at once.  Random numbers are hashes of
the row key, the unit's number in the row and the step: a row has the same pieces
in any partitioning and after any retry.

A unit longer than LONGEST is cut every LONGEST bytes, which no piece crosses, and a
text longer than SLICE is taken stretch by stretch, cut between units.  So memory is
bounded whatever the texts are, and where cuts fall depends on the text alone.

A piece's bytes are its characters with U+2581 as a space; the 256 byte pieces cover
what else a text may hold, U+2581 itself included.  So joining the bytes of the
pieces gives the text back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm import hashing
from repolith.llm.common import array_slices, text_of

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Log-probability of a byte piece before scaling, far below any other.
BYTE_LOG = -25.0
#: Text bytes whose lattice is held at once; a longer text is taken in such stretches.
SLICE = 1 << 20
#: A word of more bytes is cut every so many bytes.
LONGEST = 1 << 12


class Pieces:
    """Pieces of a model file by length, as sorted hashes with ids and log-probabilities."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        rows, self.byte_ids = [], np.zeros(256, np.int32)
        content: list[bytes] = []
        for i in range(sp.get_piece_size()):
            content.append(b"")
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                content[i] = bytes([int(piece[3:5], 16)])
                self.byte_ids[int(piece[3:5], 16)] = i
            elif (inner := piece.lstrip("▁")) and "▁" in inner:
                continue  # would cross into white space
            else:
                content[i] = piece.replace("▁", " ").encode()
                rows.append((content[i], i, sp.get_score(i)))
        top = max((s for _, _, s in rows), default=0.0)
        # a rank r of the merge list counts as probability in proportion to 1 / (r + 3)
        logs = np.array([-np.log(top - s + 3) for _, _, s in rows])
        logs -= np.log(np.exp(logs).sum()) if len(logs) else 0
        self.longest = max((len(b) for b, _, _ in rows), default=1)
        self.heads, self.tables = [], []
        for size in range(1, self.longest + 1):
            own = {_hash(b): (i, w) for (b, i, _), w in zip(rows, logs, strict=True) if len(b) == size}
            heads = sorted({_hash(b[:size]) for b, _, _ in rows if len(b) >= size})
            self.heads.append(np.array(heads, U))
            self.tables.append((np.array([own.get(h, (-1, 0))[0] for h in heads], np.int32), theta * np.array([own.get(h, (-1, 0))[1] for h in heads], float)))
        self.byte_log = theta * BYTE_LOG
        self.raw = np.frombuffer(b"".join(content), np.uint8)
        self.sizes = np.array([len(b) for b in content], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes


@lru_cache(maxsize=4)
def pieces(path: str, theta: float) -> Pieces:
    return Pieces(path, theta)


def _hash(b: bytes) -> int:
    h, p = 0, 1
    for x in b:
        h = (h + (x + 1) * p) & 0xFFFFFFFFFFFFFFFF
        p = p * int(BASE) & 0xFFFFFFFFFFFFFFFF
    return h


def _edges(p: Pieces, raw: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, size, piece, log-probability) of all edges; room: bytes left in the unit at each byte."""
    n = len(raw)
    up = np.cumprod(np.concatenate([[U(1)], np.full(n, BASE, U)]))
    down = np.cumprod(np.concatenate([[U(1)], np.full(n, _INVERSE, U)]))
    sums = np.concatenate([[U(0)], np.cumsum((raw.astype(U) + U(1)) * up[:-1])])
    alive = np.arange(n, dtype=np.int32)
    found = [(alive, np.ones(n, np.uint8), p.byte_ids[raw], np.full(n, p.byte_log))]
    for size in range(1, p.longest + 1):
        alive = alive[room[alive] >= size]
        if not len(alive):
            break
        h = (sums[alive + size] - sums[alive]) * down[alive]
        heads = p.heads[size - 1]
        k = np.minimum(np.searchsorted(heads, h), len(heads) - 1)
        ok = heads[k] == h
        alive, k = alive[ok], k[ok]
        ids, logs = p.tables[size - 1]
        hit = ids[k] >= 0  # a head of longer pieces need not be a piece
        found.append((alive[hit], np.full(int(hit.sum()), size, np.uint8), ids[k[hit]], logs[k[hit]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Lattice:
    """Forward messages of units laid side by side, and what backward sampling reads.

    Node b + u is before byte b of unit u (counted over all units); each unit has a
    node more than bytes.
    """

    def __init__(self, p: Pieces, raw: np.ndarray, sizes: np.ndarray):
        sizes = sizes.astype(np.int32)
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        unit = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        local = np.arange(len(raw), dtype=np.int32) - starts[unit]
        source, size, piece, log = _edges(p, raw, sizes[unit] - local)
        column = local[source] + size
        source += unit[source]
        target = source + size
        order = np.argsort(column.astype(np.int64) << 32 | target, kind="stable")
        source, target, column, piece, log = source[order], target[order], column[order], piece[order], log[order]
        alpha = np.zeros(len(raw) + len(sizes))
        bounds = np.searchsorted(column, np.arange(1, int(sizes.max()) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            value = alpha[source[a:b]] + log[a:b]
            first = np.flatnonzero(np.concatenate([[True], target[a + 1 : b] != target[a : b - 1]]))
            top = np.maximum.reduceat(value, first)
            wide = np.diff(np.append(first, b - a))
            alpha[target[a:b][first]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, wide)), first))
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        self.piece, self.source = piece[order], source
        self.cum = np.concatenate([[0.0], np.cumsum(np.exp(alpha[source] + log[order] - alpha[target]))])
        self.first = np.searchsorted(target, np.arange(len(alpha) + 1))
        self.begin = starts + np.arange(len(sizes), dtype=np.int32)
        self.end = self.begin + sizes

    def sample(self, unit: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all occurrences in order, how many each has); keys: 64 random bits an occurrence.

        Occurrences of a unit go through the lattice side by side, which keeps its
        nodes in the processor's cache.
        """
        order = np.argsort(unit, kind="stable")
        unit, keys = unit[order], keys[order]
        who, at, step, taken = np.arange(len(unit)), self.end[unit], 0, []
        counts = np.zeros(len(unit), np.int64)
        while len(who):
            u = (hashing.mix(keys[who] + np.array([step], U) * U(0xD1342543DE82EF95)) >> U(11)).astype(np.float64) * 2.0**-53
            a, b = self.first[at], self.first[at + 1]
            lo = self.cum[a]
            e = np.clip(np.searchsorted(self.cum, lo + u * (self.cum[b] - lo), side="right") - 1, a, b - 1)
            taken.append((who, self.piece[e]))
            counts[who] += 1
            at = self.source[e]
            on = at > self.begin[unit[who]]
            who, at, step = who[on], at[on], step + 1
        given = np.empty_like(counts)
        given[order] = counts
        ends = np.cumsum(given)[order]
        out = np.empty(int(counts.sum()), np.int32)
        for k, (w, x) in enumerate(taken):
            out[ends[w] - 1 - k] = x
        return out, given


def encode_slice(p: Pieces, raw: np.ndarray, offs: np.ndarray, row_keys: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(pieces, how many each row has, units) of the texts of a slice; before: units of the row in earlier slices."""
    hashes, starts, rows = hashing.units(raw, offs, LONGEST)
    if not len(hashes):
        return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64), 0
    _, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = np.diff(np.append(starts, len(raw)))
    lattice = Lattice(p, hashing.gather(raw, starts[first], sizes[first]), sizes[first])
    per = np.diff(rows)
    number = np.arange(before, before + len(unit)) - np.repeat(rows[:-1], per)
    keys = hashing.mix(np.repeat(row_keys, per) + hashing.mix(number.astype(U)))
    ids, counts = lattice.sample(unit, keys)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return ids, np.diff(ends[rows]), len(unit)


def encode_texts(p: Pieces, texts: pa.Array, row_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, how many each row has) of a column of texts."""
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for first, raw, offs in array_slices(texts, SLICE):
        key = row_keys[first : first + len(offs) - 1]
        if len(offs) > 2 or len(raw) <= SLICE:
            x, n, _ = encode_slice(p, raw, offs, key)
            ids.append(x)
            counts.append(n)
            continue
        places, units = hashing.cuts(raw, SLICE, forced=True), 0
        parts = []
        for a, b in zip(places[:-1], places[1:], strict=True):
            x, _, k = encode_slice(p, raw[a:b], np.array([0, b - a]), key, units)
            parts.append(x)
            units += k
        ids += parts
        counts.append(np.array([sum(len(x) for x in parts)]))
    return np.concatenate(ids), np.concatenate(counts)


def row_keys(keys: np.ndarray, seed: int) -> np.ndarray:
    return hashing.mix(keys.astype(U) + hashing.mix(np.array([seed & 0xFFFFFFFFFFFFFFFF], U)))


def encode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", out: str = "pieces", seed: int = 0, theta: float = 0.8, checked: bool = False) -> DataFrame:
    """``docs`` with an array of sampled piece ids; theta: higher takes likelier pieces.

    checked: the ids are decoded again where they are made, in the same worker, and a text that they
    don't give back fails the job.

    Rows of equal key and text get equal pieces.  Null and empty texts get an empty
    array; a null key counts as a key of its own.  All rows and other columns stay, but a
    column named ``out`` is replaced; an empty table stays empty.
    ``model_path`` is a file that every executor has.
    """

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        p = pieces(model_path, theta)
        for texts, keys in batches:
            k = row_keys(keys.to_numpy(zero_copy_only=False), seed)
            ids, counts = encode_texts(p, texts, k)
            coded = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
            if checked and not decode_texts(p, coded).equals(texts.cast(pa.large_string())):
                raise ValueError("pieces don't give the text back")
            yield coded

    return docs.withColumn(out, run(text_of(text), F.xxhash64(F.col(key).cast("string"))))


def decode_texts(p: Pieces, col: pa.Array) -> pa.Array:
    """The texts that a column of arrays of piece ids stands for; null for a null array."""
    ids = col.flatten().to_numpy(zero_copy_only=False)
    sizes = p.sizes[ids]
    raw = hashing.gather(p.raw, p.begins[ids], sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    lengths = np.array(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    offs = ends[np.concatenate([[0], np.cumsum(lengths)])]
    mask = pa.py_buffer(np.packbits(col.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes()) if col.null_count else None
    return pa.LargeStringArray.from_buffers(len(col), pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes()), mask)


def decode(docs: DataFrame, model_path: str, pieces_col: str = "pieces", out: str = "decoded") -> DataFrame:
    """``docs`` with the text that an array of piece ids stands for; null for a null array, empty for an empty one.

    All rows and other columns stay, but a column named ``out`` is replaced; an empty table stays empty.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = pieces(model_path, 1.0)
        for col in batches:
            yield decode_texts(p, col).cast(pa.string())

    return docs.withColumn(out, run(F.col(pieces_col)))
