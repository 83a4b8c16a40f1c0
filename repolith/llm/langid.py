"""Language identification in two steps: the family, then one-versus-one within it.

Features are hashed counts of 1 to 3 bytes of lower-cased letters.  Linear support
vector machines are fitted on a bounded sample of labelled rows (SAMPLE a language);
prediction is a pass over the rows with the small weight matrix broadcast.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm.common import fresh, text_of
from repolith.llm.hashing import gather

#: At most so many labelled rows a language are used for fitting, those with the least hash of their id.
SAMPLE = 600
DIMS = 1 << 13
#: What a sparse row has for each of its values: the bucket and the value.
ENTRY = np.dtype([("at", "<u2"), ("value", "<f4")])
EPOCHS = 12
BIAS = 0.3
UNKNOWN = "und"
#: Public genealogy of languages; a language not listed is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "pl": "slavic", "cs": "slavic", "ru": "slavic", "uk": "slavic"}

_LETTERS = regex.compile(r"\p{L}")
_CLASS = np.zeros(256, np.uint32)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[0x80:] = np.arange(27, 155)


def features(text: str) -> np.ndarray:
    """Unit-length vector of square roots of hashed 1- to 3-byte counts; other bytes act as one blank."""
    c = _CLASS[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = np.concatenate([[0], c[keep], [0]]).astype(np.uint32)
    two = c[:-1] * np.uint32(160) + c[1:]
    three = two[:-1] * np.uint32(160) + c[2:]
    out = np.zeros(DIMS, np.int64)
    for salt, x in ((1, c), (2, two), (3, three)):
        h = (x + np.uint32(salt << 24)) * np.uint32(2654435761)
        out += np.bincount((h >> np.uint32(19)).astype(np.int64), minlength=DIMS)
    v = np.sqrt(out.astype(np.float32))
    return v / max(float(np.linalg.norm(v)), 1e-9)


def sparse(text: str) -> bytes:
    """The entries of ``features`` other than 0."""
    v = features(text)
    out = np.empty(np.count_nonzero(v), ENTRY)
    out["at"] = np.flatnonzero(v)
    out["value"] = v[out["at"]]
    return out.tobytes()


class Rows:
    """Sparse rows one after another; a few of them at a time are made dense."""

    def __init__(self, rows: list[bytes]):
        flat = np.frombuffer(b"".join(rows), ENTRY)
        self.at, self.value = flat["at"].astype(np.int32), np.ascontiguousarray(flat["value"])
        self.ends = np.cumsum([0, *(len(r) // ENTRY.itemsize for r in rows)])

    def dense(self, part: np.ndarray) -> np.ndarray:
        """Rows ``part`` with a last column for the bias."""
        sizes = self.ends[part + 1] - self.ends[part]
        out = np.zeros((len(part), DIMS + 1), np.float32)
        out[np.repeat(np.arange(len(part)), sizes), gather(self.at, self.ends[part], sizes)] = gather(self.value, self.ends[part], sizes)
        out[:, -1] = BIAS
        return out


def svm(x: Rows, on: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, lam: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights (the bias last) of a linear SVM for rows ``on`` with labels ``y`` of -1 or 1, and the median margin.

    Hinge loss, averaged stochastic subgradient.
    """
    w, mean, t, rng = np.zeros(DIMS + 1), np.zeros(DIMS + 1), 0, np.random.default_rng(seed)
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            t += 1
            rows = x.dense(on[part])
            bad = y[part] * (rows @ w) < 1
            step = 1 / (lam * (t + 1000))
            w *= 1 - step * lam
            if bad.any():
                w += step * ((y[part] * weight[part])[bad] @ rows[bad]) / len(part)
            mean += (w - mean) / t if t > 1 else w
    margins = [np.abs(x.dense(part) @ mean) for part in np.array_split(on, max(1, len(on) // 32))]
    return mean, float(np.median(np.concatenate(margins)))


class Model:
    """Family classifiers and, by family, classifiers of its languages; all one-versus-one.

    ``pairs`` is a list of (family or None, first, second); row k of ``weights``
    is positive for the first.  With one class there is nothing to compare.
    """

    def __init__(self, langs: list[str], pairs: list[tuple], weights: np.ndarray, scales: np.ndarray):
        self.langs, self.pairs, self.weights, self.scales = langs, pairs, weights, scales
        self.families = sorted({family(x) for x in langs})

    def _vote(self, level: str | None, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The class with most votes (then summed margin, then name) and its least confidence in a pair."""
        if len(names) == 1:
            return names[0], 1.0
        votes, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for (lev, a, b), m in zip(self.pairs, margins, strict=True):
            if lev != level:
                continue
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            p = float(1 / (1 + np.exp(-np.clip(m, -30, 30))))
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        best = min(names, key=lambda x: (-votes[x], -sums[x], x))
        return best, least[best]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, confidence); UNKNOWN and 0 for null or a text without letters."""
        if not text or not self.langs or not _LETTERS.search(text):
            return UNKNOWN, 0.0
        v = features(text)
        m = (self.weights[:, :-1] @ v + BIAS * self.weights[:, -1]) * self.scales if len(self.pairs) else np.zeros(0)
        fam, p = self._vote(None, self.families, m)
        lang, q = self._vote(fam, sorted(x for x in self.langs if family(x) == fam), m)
        return lang, p * q


def family(lang: str) -> str:
    return FAMILIES.get(lang, lang)


def sampled(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(lang, h, v): hashed key and sparse vector of at most ``sample`` rows of each language, as ``fit`` takes them."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), text_of(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("h")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    least = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(4.0 * sample) / F.col("n"))
    # a row a language, whatever their number
    shares = F.broadcast(least.select("lang", share.alias("p")))
    near = rows.join(shares, "lang").where((F.col("h").cast("double") / float(2**63) + 1) / 2 <= F.col("p")).select("lang", "text", "h")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of least hash in this task, as feature vectors."""
        kept: dict[str, list] = {}
        for b in batches:
            for r in b.itertuples(index=False):
                kept.setdefault(r.lang, []).append((r.h, sparse(r.text)))
            for k, v in kept.items():
                kept[k] = sorted(v)[:sample]
        for k, v in kept.items():
            yield pd.DataFrame({"lang": k, "h": [x[0] for x in v], "v": [x[1] for x in v]})

    # at most sample rows a language and task reach the ranking below, as sparse vectors of at most DIMS entries
    ranked = near.mapInPandas(take, "lang string, h long, v binary").selectExpr("*", "row_number() over (partition by lang order by h, v) as k")
    return ranked.where(F.col("k") <= sample).drop("k")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows a language; rows with null text or language or without letters don't count.

    Rows travel and stay sparse; 32 at a time are made dense.  The sample is the rows of least hashed key, picked by a bounded aggregate, so a
    frequent language costs no more than a rare one.  All languages count, so the driver's
    work grows with the square of their number.  An empty table gives a model that knows no language.
    """
    got = sampled(docs, text, lang, key, sample).orderBy("lang", "h", "v").collect()
    if not got:
        return Model([], [], np.zeros((0, DIMS + 1)), np.zeros(0))
    x = Rows([bytes(r["v"]) for r in got])
    y = np.array([r["lang"] for r in got])
    langs = sorted(set(y))
    fams = np.array([family(k) for k in y])
    pairs: list[tuple] = [(None, a, b) for a, b in itertools.combinations(sorted(set(fams)), 2)]
    for f in sorted(set(fams)):
        pairs += [(f, a, b) for a, b in itertools.combinations([k for k in langs if family(k) == f], 2)]
    weights, scales = [], []
    for level, a, b in pairs:
        names = fams if level is None else y
        on = np.flatnonzero((names == a) | (names == b))
        w, margin = svm(x, on, np.where(names[on] == a, 1.0, -1.0))
        weights.append(w.astype(np.float32))
        scales.append(6.0 / max(1e-6, margin))
    return Model(langs, pairs, np.array(weights).reshape(len(pairs), DIMS + 1).astype(np.float32), np.array(scales))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the text alone; all rows stay.

    Null and empty texts and those without a letter (Unicode class L) are UNKNOWN with score 0.
    Columns named ``lang_pred`` or ``score`` are replaced, all others stay; an empty table stays empty.

    The model (a few hundred kB, set by the number of languages) is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([held.value.predict(x) for x in texts], columns=["lang", "score"])

    name = fresh("_guess", docs)
    out = docs.withColumn(name, guess(F.col(text).cast("string")))
    return out.withColumn("lang_pred", F.col(f"{name}.lang")).withColumn("score", F.col(f"{name}.score")).drop(name)
