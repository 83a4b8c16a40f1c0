"""64-bit hashes of words and of runs of words over a slice of texts, in numpy.

Equal words have equal hashes in every task.  A word's hash sums a scrambled value
of each byte and its place, so no pattern of bytes cancels out; two different words
share one with a chance of about 2**-64 a pair, which the operators take as never.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (multiply and xor-shift); a bijection."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: Places whose values of all bytes are kept in a table (128 kB).
_PLACES = 64


def _value(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(mix((place.astype(U) + U(1)) * U(0xA24BAED4963EE407)) ^ _BYTE[byte])


_TABLE = _value(np.tile(np.arange(256), _PLACES), np.repeat(np.arange(_PLACES), 256))
_TABLE_FOLDED = _TABLE.reshape(_PLACES, 256)[:, _FOLD].ravel()
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ALNUM = np.array([chr(c).isascii() and chr(c).isalnum() for c in range(256)])
_MARK = np.array([0x20 < c < 0x7F and not chr(c).isalnum() for c in range(256)])
_BASE = U(0x2545F4914F6CDD1D)
_POWERS = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """At least n powers of the odd base, kept from call to call."""
    global _POWERS
    if len(_POWERS) < n:
        out = np.full(max(n, 4096), _BASE, U)
        out[0] = U(1)
        _POWERS = np.cumprod(out)
    return _POWERS


def _values(raw: np.ndarray, place: np.ndarray, fold: bool) -> np.ndarray:
    """A scrambled value of each byte and its place in the word."""
    out = (_TABLE_FOLDED if fold else _TABLE)[(np.minimum(place, _PLACES - 1) << 8) | raw]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        out[far] = _value(_FOLD[raw[far]] if fold else raw[far], place[far])
    return out


def words(raw: np.ndarray, offs: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each row, where its words begin (rows + 1 values).

    Words are runs of bytes other than space and 0x09-0x0D.  fold: A-Z as a-z.
    """
    rows = len(offs) - 1
    if not len(raw):
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    sep = _SEP[raw]
    begins = np.empty(len(raw), bool)
    begins[0] = True
    begins[1:] = sep[:-1]
    begins[offs[:-1][offs[:-1] < len(raw)]] = True
    begins &= ~sep
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    at = np.repeat(starts, np.diff(np.append(starts, len(raw))))
    place = np.arange(starts[0], len(raw)) - at
    value = _values(raw[starts[0] :], place, fold)
    value[sep[starts[0] :]] = U(0)
    return mix(np.add.reduceat(value, starts - starts[0])), np.searchsorted(starts, offs)


def runs(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within rows, and where each row's runs begin."""
    counts = np.maximum(np.diff(bounds) - (width - 1), 0)
    begins = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    total = int(begins[-1])
    if not total:
        return np.zeros(0, U), begins
    first = np.arange(total) - np.repeat(begins[:-1], counts) + np.repeat(bounds[:-1], counts)
    step, out = powers(width + 1), np.zeros(total, U)
    for k in range(width):
        out += hashes[first + k] * step[k + 1]
    return mix(out), begins


def _marks_after_words(raw: np.ndarray) -> np.ndarray:
    """Places of ASCII marks behind a letter up to U+00FF or an ASCII digit."""
    at = np.flatnonzero(_MARK[raw[1:]]) + 1
    before = raw[at - 1]
    latin = (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (raw[at - 2] == 0xC3)  # without the signs of times and division
    return at[_ALNUM[before] | latin]


def _unit_begins(raw: np.ndarray) -> np.ndarray:
    begins = np.zeros(len(raw), bool)
    sep = _SEP[raw]
    solid = ~sep & (raw > 0x20) & (raw < 0x7F)
    solid[1:] |= (raw[1:] >= 0x80) & (raw[:-1] == 0xC3)
    begins[1:] = sep[1:] & solid[:-1]
    return begins


def is_space(byte: np.ndarray) -> np.ndarray:
    """Whether bytes are a space or 0x09-0x0D."""
    return _SEP[byte]


def ends_solid(raw: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether the characters before ``stops`` are such that white space behind them begins a unit."""
    last = raw[stops - 1]
    return ((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (raw[stops - 2] == 0xC3))


def cuts(raw: np.ndarray, limit: int, forced: bool = False) -> list[int]:
    """Where a text falls into stretches of about ``limit`` bytes, its two ends included.

    Cuts stand between units; forced: also every ``limit`` bytes within a longer unit.
    They depend on the text alone, and memory on ``limit`` (and the longest unit).
    """
    out, at, width = [0], 0, limit
    while len(raw) - at > width:
        spots = np.flatnonzero(_unit_begins(raw[at : at + width + 1]))
        if not len(spots) and not forced:
            width *= 2
            continue
        at, width = at + (int(spots[-1]) if len(spots) else width), limit
        out.append(at)
    return [*out, len(raw)]


def units(raw: np.ndarray, offs: np.ndarray, longest: int = 0, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and first bytes of all units, and where each row's units begin.

    A unit is a run of white space and what follows up to the next one, so units
    side by side are the text.  No unit begins where the byte before might belong to
    white space outside ASCII.  longest: a longer unit falls into units of so many bytes.
    marks: units also begin at an ASCII mark behind a letter or digit.
    """
    if not len(raw):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    begins = _unit_begins(raw)
    begins[offs[:-1][offs[:-1] < len(raw)]] = True
    if marks:
        begins[_marks_after_words(raw)] = True
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(raw)))
    if longest and sizes.max() > longest:
        for a, n in zip(starts[sizes > longest].tolist(), sizes[sizes > longest].tolist(), strict=True):
            begins[a : a + n : longest] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(raw)))
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    return mix(np.add.reduceat(_values(raw, place, False), starts)), starts, np.searchsorted(starts, offs)


def gather(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[begins[k] : begins[k] + sizes[k]] for all k, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(begins - (ends - sizes), sizes)]
