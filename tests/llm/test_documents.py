"""Operators against plain versions, over the smallest tables and awkward rows."""

import pytest

from repolith.llm import decontam, jaccard, langid, pieces, pii, quality
from repolith.llm import queries as Q

from . import brute

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "a.b@c.d.e@f.g x@y 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +1 (555) 555-2485 +12 +1 2"),
    (5, "é" * 40_000 + " end"),
    (6, "one two"),
    (7, "One TWO"),
    (8, "one two"),
    (9, "▁  x  y \U0001f600 <0x41>  two  spaces\n\n"),
    (10, " ".join(f"w{i}" for i in range(30_000))),
    (11, "00255.1.1.0001 1-2-3 000000000000000 4111-1111-1111-1111.1.2.3 me@@x.y @a.b +1()2 https://u:pw@h.io account: GB82 WEST 1234 5698 7654 32"),
    (11, "repeated key"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in ODD], "doc_id long, text string, _w string, n int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_pii(spark, odd, docs):
    for df in (odd, docs):
        got = sorted((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.digest(pii.find(df)).collect())
        want = []
        for d, t in rows(df):
            s = brute.pii(t)
            want.append((d, brute.pii_sha(s), *(sum(x[0] == k for x in s) for k in pii.BASE)))
        assert got == sorted(want)
    assert {"account"} <= {x[0] for x in pii.spans_of(ODD[10][1])}
    assert pii.mask("mail a@b.cd now") == "mail <EMAIL> now" and pii.mask(None) is None
    assert pii.find(odd.limit(0)).count() == 0


def test_quality(spark, odd, docs):
    for df in (odd, docs):
        got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.measures(df).collect())
        assert got == sorted((d, *brute.quality(t)) for d, t in rows(df))
    r = {x["doc_id"]: x for x in quality.score(docs).collect()}
    assert sum(x["kept"] for x in r.values()) > 0.6 * len(r) and not any(x["kept"] and x["base_failed"] for x in r.values())
    assert quality.score(odd.limit(0)).count() == 0


def test_near_duplicates(spark, odd, docs):
    for df in (docs, odd.where("doc_id < 11")):
        want = brute.near(rows(df))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
        assert got == want
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0
    kept = {r["doc_id"] for r in jaccard.drop_near_duplicates(odd).collect()}
    assert {1, 2, 3, 6} <= kept and not {7, 8} & kept


def test_near_duplicates_of_a_chain_and_a_crowd(spark, monkeypatch):
    import random

    rng = random.Random(3)
    base = [f"t{rng.randrange(50)}" for _ in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
        texts.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(30):
        texts.append((1000 + i, " ".join(chain)))
        chain = chain[4:] + [f"d{i}_{k}" for k in range(4)]
    monkeypatch.setattr(jaccard, "BLOCK", 2_000)  # so groups are split
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()} == brute.near(texts)


def test_leaks(spark, docs, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    clean = lambda t: [w for w in ("".join(c for c in x if c not in decontam.PUNCTUATION) for x in brute.words(t)) if w]
    whole = set()
    for d, t in rows(docs):
        w = clean(t)
        for i, x in items:
            y = clean(x)
            if len(y) >= 8 and any(w[k : k + len(y)] == y for k in range(len(w) - len(y) + 1)):
                whole.add((d, i))
    assert whole <= got and len(got) < 0.2 * docs.count()
    item = items[0][1].split()
    swapped = [x if k % 7 else "zz" for k, x in enumerate(item)]
    planted = [(1, " ".join(["pre"] * 5 + swapped + ["post"])), (2, "nothing here"), (3, None), (1, "other")]
    df = spark.createDataFrame(planted, "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.leaks(df, bench).collect()] == [(1, items[0][0])]
    assert decontam.drop_leaks(df, bench).count() == 2
    assert decontam.leaks(odd, bench.limit(0)).count() == 0 and decontam.leaks(odd.limit(0), bench).count() == 0


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = Q.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.97 * len(got)
    model = langid.fit(docs)
    assert {r["doc_id"] for r in langid.predict(odd, model).where("lang_pred = 'und'").collect()} == {1, 2, 3}
    assert langid.predict(odd.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_pieces(spark, odd, docs):
    path = Q.tokenizer_file("piece_bpe_32k.model")
    for df in (odd, docs):
        got = pieces.decode(pieces.encode(df, path, seed=5), path).collect()
        assert all(r["decoded"] == (r["text"] or "") for r in got)
    a = {(r["doc_id"], r["text"]): r["pieces"] for r in pieces.encode(odd, path, seed=5).collect()}
    b = {(r["doc_id"], r["text"]): r["pieces"] for r in pieces.encode(odd.repartition(5), path, seed=5).collect()}
    c = {(r["doc_id"], r["text"]): r["pieces"] for r in pieces.encode(odd, path, seed=6).collect()}
    assert a == b != c
    assert pieces.encode(odd.limit(0), path).count() == 0


def test_piece_samples_follow_the_lattice():
    """Frequencies of sampled segmentations of a word against the probabilities of all of them."""
    import math
    from collections import Counter

    import numpy as np

    p = pieces.pieces(Q.tokenizer_file("piece_bpe_32k.model"), 0.8)
    word = b" that"
    raw = np.frombuffer(word, np.uint8)
    at, size, piece, log = pieces._edges(p, raw, len(raw) - np.arange(len(raw)))
    edges = list(zip(at.tolist(), size.tolist(), piece.tolist(), log.tolist(), strict=True))

    def paths(k):
        return [((), 0.0)] if k == len(raw) else [((i, *rest), w + u) for a, s, i, w in edges if a == k for rest, u in paths(k + s)]

    exact = {ids: math.exp(w) for ids, w in paths(0)}
    total = sum(exact.values())
    n = 20_000
    ids, counts, _ = pieces.encode_slice(p, np.tile(raw, n), np.arange(n + 1) * len(raw), pieces.row_keys(np.arange(n), 1))
    ends = np.cumsum(counts)
    seen = Counter(tuple(ids[e - k : e].tolist()) for e, k in zip(ends, counts, strict=True))
    for path, w in exact.items():
        q = w / total
        assert abs(seen[path] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3
