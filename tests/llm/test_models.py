"""Models against plain versions: EM, bigram scores, spaced seeds, SQL."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from repolith.llm import decontam, lm, quality
from repolith.llm import queries as Q

from ..oracle import compare
from . import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got, want, _ = compare(spark, SF, Q.queries()[name], Q.oracle_sql()[name])
    assert got == want and got[1]


def plain_em(rows, iterations):
    """Prior and accuracies from rows of votes, one row at a time."""
    k = len(rows[0])
    prior, acc = 0.9, [(quality.MAX_A, 0.25)] * k
    clip = lambda x, lo, hi: min(hi, max(lo, x))

    def posterior(votes):
        good, bad = prior, 1 - prior
        for v, (a, b) in zip(votes, acc, strict=True):
            if v is not None:
                good, bad = good * (a if v else 1 - a), bad * ((1 - b) if v else b)
        return good / (good + bad)

    for _ in range(iterations):
        q = [posterior(r) for r in rows]
        sums = [[[sum(p if side else 1 - p for p, r in zip(q, rows, strict=True) if r[j] == v) for v in (0, 1)] for side in (1, 0)] for j in range(k)]
        prior = clip((sum(q) + 8) / (len(rows) + 10), 0.01, 0.99)
        acc = [(clip((g[1] + 1) / (g[1] + g[0] + 1), quality.LEAST_A, quality.MAX_A), clip((b[0] + 1) / (b[0] + b[1] + 4), quality.MIN_B, quality.MAX_B)) for g, b in sums]
    return [posterior(r) for r in rows]


def test_posterior_equals_plain_em(spark):
    rows = quality.score(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    names = [f"vote_{x}" for x in quality.rules()]
    want = plain_em([[r[x] for x in names] for r in rows], quality.ITERATIONS)
    assert all(abs(r["quality"] - w) < 1e-6 for r, w in zip(rows, want, strict=True))
    assert all(r["kept"] == (not r["base_failed"] and w >= 0.5) for r, w in zip(rows, want, strict=True))


def test_estimates_find_the_accuracies_of_made_up_rules(spark):
    rng, true = random.Random(1), [(0.95, 0.8), (0.9, 0.6), (0.97, 0.5), (0.85, 0.7)]
    votes = []
    for _ in range(6000):
        good = rng.random() < 0.8
        votes.append(tuple(None if rng.random() < 0.1 else int(rng.random() < a) if good else int(rng.random() >= b) for a, b in true))
    names = [f"v{k}" for k in range(4)]
    prior, acc = quality.estimate(spark.createDataFrame(votes, ", ".join(f"{n} int" for n in names)), names, 60)
    assert abs(prior - 0.8) < 0.05
    assert all(abs(acc[n][0] - a) < 0.05 and abs(acc[n][1] - b) < 0.1 for n, (a, b) in zip(names, true, strict=True))


def test_scores_equal_a_plain_bigram_model(spark):
    """Counts rounded to powers of two as in the filter, but held exactly; the filter's false hits may move a little."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: brute.words(r["text"]) + [None] for r in docs.collect()}
    train = [t for k, t in texts.items() if k % 7 != 2]
    one, two = Counter(x for t in train for x in t), Counter(p for t in train for p in zip([None, *t], t, strict=False))
    n, v = sum(one.values()), len(one)

    def rounded(c):
        level = 1 + int(math.log2(c)) if c else 0
        return 0.0 if not level else 2.0 ** (level - 1) * (1.42 if level > 1 else 1.0)

    def score(t):
        out = 0.0
        for a, b in zip([None, *t], t, strict=False):
            before, uni = rounded(one[a]), (rounded(one[b]) + 1) / (n + v + 1)
            out += math.log10((min(rounded(two[a, b]), rounded(one[b]), before) + lm.MU * uni) / (before + lm.MU))
        return out

    got = {r["doc_id"]: (r["score"], r["n_tokens"]) for r in lm.score(docs, F.col("doc_id") % 7 != 2).collect()}
    off = [abs(got[k][0] - score(t)) / len(t) for k, t in texts.items()]
    assert max(off) < 0.25 and sum(off) / len(off) < 0.05


def test_substitutions_in_windows_are_found(spark):
    """Random substitutions up to a fifth of a window's words, over items of several lengths."""
    rng, items, docs = random.Random(5), [], []
    for k in range(120):
        n = rng.choice((10, 15, 20, 25, 40))
        items.append((k, " ".join(f"i{k}w{j}" for j in range(n))))
        words = items[-1][1].split()
        for j in rng.sample(range(min(n, 20)), min(n, 20) // 5):
            words[j] = f"z{rng.randrange(1000)}"
        docs.append((k, " ".join([f"p{rng.randrange(99)}" for _ in range(rng.randrange(30))] + words + ["tail"] * rng.randrange(9))))
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r["doc_id"] == r["item_id"] for r in got) and len(got) >= 0.97 * len(docs)


def test_a_filter_in_shards_scores_as_one_that_is_broadcast(spark, monkeypatch):
    """Many shards, few heavy n-grams, a long text, repeated and null keys and texts: both ways agree to the last bit."""
    monkeypatch.setattr(lm, "SHARD", 500)
    monkeypatch.setattr(lm, "FREQUENT", 64)
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(rng.randrange(60)))) for k in range(300)]
    rows += [(7, "w1 w2 again"), (7, "w1 w2 again"), (None, "w3 w4"), (400, None), (401, ""), (402, " ".join(f"v{k % 70000}" for k in range(200000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 7 != 2
    one, other = (sorted(map(repr, lm.score(docs, train, broadcast_bytes=b).collect())) for b in (1 << 40, -1))
    assert one == other and len(one) == len(rows)
    heavy = lm.build(docs, 40, 50).agg(F.sum(F.octet_length("heavy")), F.sum(F.octet_length("levels"))).first()
    assert heavy[0] == 8 * heavy[1] > 0
