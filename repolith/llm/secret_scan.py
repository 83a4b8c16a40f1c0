"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest is Spark's own, fitted on labelled findings (a bounded table); candidates
are few beside the text, and everything about one is in its own row.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm.common import text_of

_ASSIGNED = re.compile(
    r"""(?i)(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)["']?[ \t]*(?:=>|:=|=|:)[ \t]*"""
    r"""(?:"([^"\r\n]{8,}+)"|'([^'\r\n]{8,}+)'|`([^`\r\n]{8,}+)`|["'`]?((?=[^\s"'`;<>]{8})[^\s"'`,;<>]++(?:,[^\s"'`,;<>]++)*+))"""
)
#: The password of an address, and the body of a private key in its armour.
_ADDRESS = re.compile(r"""://[^\s/:@"'`<>]{0,255}:([^\s/@"'`<>]{4,}+)@""")
_ARMOUR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----\s*+([A-Za-z0-9+/=\s]{16,}+)-----END")
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z0-9+/_=.-]{16})(?=[A-Za-z+/_=.-]*+[0-9])(?=[0-9+/_=.-]*+[A-Za-z])[A-Za-z0-9+/_=.-]{16,}+")
_CUE = re.compile(r"(?i)token|secret|passw|pwd|api.?key|access.?key|credential|auth|bearer|private")
_NOT = re.compile(r"(?i)sha\d*|md5|commit|hash|checksum|digest|uuid|revision|integrity|version|file|path|example|placeholder")
_PATH = re.compile(r"[\w.-]/[\w.-]|\.[a-z]{1,4}$")
#: Fixed list of words that tell names from keys.
WORDS = "about access account action after array async base before block build button cache call change check class client close code column component config connect const content context control core count create data date default delete description device document download edit element email error event example export false field file filter find first folder format from function get global group handler header home html icon image import index info input insert into item json label last layout level library line link list load local login main manager master menu message method model module name network node number object open option order output package page param parent password path path place process project property provider public query read record remove render report request reset resource response result return route sample save schema script search section select server service session setting size source stack start state status step stop store string style submit system table task template test text that this time title token true type update upload user util value version view width window with word your".split()
_WORDS = re.compile("|".join(sorted({w for w in WORDS if len(w) >= 4}, key=len, reverse=True)), re.I)
FEATURES = ("length", "transitions", "letters", "digits", "upper", "entropy", "dictionary", "path", "cue", "other_cue", "assigned", "quoted", "hex", "repeats")
NEAR = 40
TREES, DEPTH, SEED = 20, 6, 11


def features(value: str, before: str, after: str, assigned: bool) -> list[float]:
    """Numbers of a candidate and its neighbours, in the order of FEATURES."""
    n = max(1, len(value))
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value]
    counts = Counter(value)
    return [
        float(min(len(value), 200)),
        sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / n,
        sum(c.isalpha() for c in value) / n,
        kind.count("d") / n,
        kind.count("u") / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(len(m) for m in _WORDS.findall(value)) / n,
        float(bool(_PATH.search(value))) + value.count("/") / n,
        float(bool(_CUE.search(before))),
        float(bool(_NOT.search(before))),
        float(assigned),
        float(before[-1:] in "\"'`" and before != "" and after[:1] in "\"'`" and after != ""),
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        max(counts.values(), default=0) / n,
    ]


def candidates(text: str | None) -> list[tuple[int, int, str, list[float]]]:
    """(start, end, rule, features) in a text by start; of candidates that overlap, the first kind named here stays.

    Kinds: the body of a private key (``key``), the password of an address (``address``), a value
    beside a cue (``assigned``: to its closing quote where it has one), a run of key-like
    characters (``bare``).  A candidate of any length is whole; only the feature of its length is bounded.
    """
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    for rule, pattern in (("key", _ARMOUR), ("address", _ADDRESS), ("assigned", _ASSIGNED), ("bare", _BARE)):
        taken, k, new = sorted(spans), 0, []
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex or 0)
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k == len(taken) or taken[k][0] >= b:
                new.append((a, b, rule))
        spans += new
    return [(a, b, rule, features(text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR], rule != "bare")) for a, b, rule in sorted(spans)]


def labelled_findings(spark: SparkSession, n: int = 2000, seed: int = SEED) -> DataFrame:
    """(value, before, after, assigned, label): n made-up findings, half of them real secrets.

    Half of the names are of made-up syllables, which no dictionary has, so the forest
    cannot tell names by the dictionary alone.
    """
    rng, rows = random.Random(seed), []
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for k in range(n):
        if k % 2:
            kinds = [
                lambda: pick(hexa, 16, 64),
                lambda: pick(alnum, 16, 48),
                lambda: pick(alnum[:26] + hexa[:10], 16, 32),
                lambda: pick("abcdefghijklmnopqrstuvwxyz", 2, 4) + rng.choice("_-") + pick(alnum, 20, 40),
                lambda: pick(alnum + "+/", 24, 60) + "=",
                lambda: ".".join(pick(alnum + "-_", a, b) for a, b in ((20, 40), (40, 160), (30, 60))),
                lambda: pick(alnum + "!@#%", 10, 20),
                lambda: "\n".join(pick(alnum + "+/", 64, 64) for _ in range(rng.randint(1, 25))) + "\n",
                lambda: ",".join(pick(alnum, 6, 12) for _ in range(2)),
            ]
            value = rng.choice(kinds)()
            bare = rng.random() < 0.15
            before = "" if bare else rng.choice(["token = \"", "password=", "api_key: '", "secret := ", "auth_token=", "access_key = \"", "://admin:"])
            rows.append((value, before, "\"" if before.endswith("\"") else "'" if before.endswith("'") else " ", not bare, 1))
        else:
            syllable = lambda: rng.choice("bcdfghklmnprstvw") + rng.choice(["a", "e", "i", "o", "u", "an", "er", "in", "or"])
            word = lambda: rng.choice(WORDS) if rng.random() < 0.5 else "".join(syllable() for _ in range(rng.randint(2, 4)))
            made = rng.randrange(11)
            value = [
                lambda: "/".join(word() for _ in range(4)) + ".py",
                lambda: "".join(word().capitalize() for _ in range(4)) + str(rng.randint(1, 99)),
                lambda: "_".join(word() for _ in range(4)) + str(rng.randint(1, 9)),
                lambda: pick(hexa, *rng.choice([(32, 32), (40, 40), (64, 64)])),
                lambda: "-".join([pick(hexa, 8, 8), pick(hexa, 4, 4), pick(hexa, 4, 4), pick(hexa, 4, 4), pick(hexa, 12, 12)]),
                lambda: rng.choice("ax0*") * rng.randint(16, 30) + "1a",
                lambda: "your_" + word() + "_here1",
                lambda: ".".join(word() for _ in range(rng.randint(2, 4))) + rng.choice(["", "()", ".v2"]),
                lambda: f"20{rng.randint(10, 30)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}.{rng.randint(10, 59)}",
                lambda: rng.choice(["process.env.", "env.", "config.", "settings[", "${"]) + "_".join(word().upper() for _ in range(rng.randint(2, 3))) + rng.choice(["", "1", "_2"]),
                lambda: "-".join(word() for _ in range(3)) + f"-{rng.randint(1, 20)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}",
            ][made]()
            cues = ["sha1: ", "sha256: ", "md5 ", "commit ", "checksum=", "integrity=", "uuid ", "version "] if made in (3, 4) else ["password=", "token: ", "secret = \"", "api_key: '"] if made == 9 else [" ", "import ", "path = \"", "see ", "name: '", "password=", "token: ", "secret = \""]
            before = rng.choice(cues)
            rows.append((value, before, before[-1] if before[-1] in "\"'" else " ", bool(re.search("password|token|secret|api_key", before)), 0))
    return spark.createDataFrame(rows, "value string, before string, after string, assigned boolean, label int")


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    """A forest over labelled findings; the same findings and seed give the same forest."""

    def numbers(v: pd.Series, b: pd.Series, a: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([features(*x) for x in zip(v, b, a, s, strict=True)], dtype=object)

    f = F.pandas_udf(numbers, "array<double>")("value", "before", "after", "assigned")
    rows = findings.select(array_to_vector(f).alias("features"), F.col("label").cast("double"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row for each candidate: (doc_id, start, end, rule, value_sha256, probability, is_secret).

    Places are code points, end exclusive.  Null and empty texts have no candidates; a null key
    stays null; repeated rows give theirs again; an empty table gives an empty one; other columns
    are not read.  Digests are taken where a text is searched, so it does not go along with its candidates.
    """

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start": a, "end": b, "rule": r, "sha": hashlib.sha256(t[a:b].encode()).hexdigest(), "x": f} for a, b, r, f in candidates(t)] for t in texts], dtype=object)

    found = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("_t")).withColumn("_c", F.pandas_udf(find, "array<struct<start:long,end:long,rule:string,sha:string,x:array<double>>>")("_t"))
    rows = found.select("doc_id", "_c").select("doc_id", F.explode("_c").alias("c"))  # the text ends here
    rows = rows.select("doc_id", "c.start", "c.end", "c.rule", F.col("c.sha").alias("value_sha256"), array_to_vector("c.x").alias("features"))
    p = F.round(vector_to_array("probability")[1], 6)
    return model.transform(rows).select("doc_id", "start", "end", "rule", "value_sha256", p.alias("probability"), (p >= threshold).alias("is_secret"))
