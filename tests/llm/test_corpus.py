"""Operators over a whole corpus, and the pipeline, against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolith.llm import lm, repeats, secret_scan, tokenids
from repolith.llm import queries as Q

from . import brute
from .test_documents import ODD, SF, rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in ODD], "doc_id long, text string, _w string, n int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_lm(spark, docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.where("doc_id < 11").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    texts = rows(both)
    train = Counter()
    for d, t in texts:
        if brute.crc(d, 7) != 2:
            train.update([*brute.words(t), None])
    n, v = sum(train.values()), len(train)
    held = Q.remainder("doc_id", 7) == 2
    got = {r["doc_id"]: r for r in lm.score(both, ~held).collect()}
    for d, t in texts:
        toks = [*brute.words(t), None]
        want = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in toks)
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(toks), sum(train[x] > 0 for x in toks), n)
        assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want)) and r["score"] < 0
    apart = {r["doc_id"]: r["score"] for r in lm.score(both, ~held, broadcast_bytes=0).collect()}
    assert all(abs(apart[d] - got[d]["score"]) < 1e-6 * abs(apart[d]) for d in apart)
    assert lm.score(odd.limit(0), F.lit(True)).count() == 0
    assert {r["n_known"] for r in lm.score(odd, F.lit(False)).collect()} == {0}


def test_filter_never_forgets():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    c = rng.integers(1, 40, len(h)).astype(np.uint32)
    f = lm.Filter([(0, lm._shard_bits([h.tobytes()], [c.tobytes()]))], 1)
    low = np.exp2(np.floor(np.log2(c)))
    assert (f.counts(h) >= low).all() and (f.counts(h) > 1.5 * low).mean() < 0.06
    assert (f.counts(rng.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.06


def test_repeats(spark, docs, odd):
    crowd = "shared passage of more than fifty bytes, é repeated in many documents. "
    made = [(i, f"{i} " * (i % 40) + crowd * (1 + i % 2) + "tail " * (i % 7)) for i in range(300)]
    for df in (docs.where("doc_id < 120"), odd.where("doc_id < 11"), spark.createDataFrame(made, "doc_id long, text string")):
        got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove(df).collect())
        assert got == brute.repeats(rows(df))
    assert repeats.remove(odd.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, crowd), (1, crowd), (None, crowd)], "doc_id long, text string")
    assert sum(r["n_removed"] for r in repeats.remove(twice).collect()) == 0


def test_token_ids(spark, docs, odd):
    path = Q.tokenizer_file("byte_bpe_50k.json")
    t = tokenids.tokenizer(path)
    extra = [(1, "a   b　c  d  e"), (2, "it's  we'll\n\n\tx"), (3, "<|endoftext|> é\u0085 y"), (4, None)]
    for df in (docs, odd.where("doc_id < 11"), spark.createDataFrame(extra, "doc_id long, text string")):
        start, want = 0, []
        for d, x in sorted(rows(df), key=lambda r: r[0]):
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(tuple(r) for r in tokenids.write_and_read(df, path).collect()) == want
    ids = np.arange(50_000, dtype=np.uint32) * 7919 % 50257
    assert (tokenids.unpack(*tokenids.pack(ids)) == ids).all()
    assert tokenids.write_and_read(odd.limit(0), path).count() == 0


def test_secrets(spark, odd):
    model = secret_scan.fit(secret_scan.labelled_findings(spark))
    rest = secret_scan.labelled_findings(spark, 400, seed=99)
    df = rest.selectExpr("monotonically_increasing_id() as doc_id", "concat('word ', before, value, after, ' word') as text", "label")
    got = {r["doc_id"] for r in secret_scan.scan(df, model).where("is_secret").collect()}
    want = {r["doc_id"]: r["label"] for r in df.collect()}
    right = sum((d in got) == bool(y) for d, y in want.items())
    assert right > 0.93 * len(want)
    text = "a token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" b"
    one = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    (r,) = secret_scan.scan(one, model).collect()
    assert (r["doc_id"], text[r["start"] : r["end"]], r["is_secret"]) == (1, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", True)
    assert secret_scan.scan(odd.limit(0), model).count() == 0 and secret_scan.scan(odd, model).count() >= 0


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r for r in P.run(spark, SF).collect()}
    near = brute.near(rows(docs))
    assert 0.5 * docs.count() < len(out) and all(r["pieces"] for r in out.values())
    firsts = {c for _, c in near.values()}
    assert {d for d in out} <= firsts
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_long_secrets_are_whole(spark):
    import hashlib

    jwt, key = "eyJhbGciOiJIUzI1NiJ9." + "aB3dE6g" * 60 + ".c0ffee", "k3Zq9" * 50
    text = f"é Authorization: Bearer {jwt} then token = \"{key}\", end"
    assert [(text[a:b], rule) for a, b, rule, _ in secret_scan.candidates(text)] == [(jwt, "bare"), (key, "assigned")]
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = secret_scan.scan(one, secret_scan.fit(secret_scan.labelled_findings(spark))).orderBy("start").collect()
    assert [r["value_sha256"] for r in got] == [hashlib.sha256(x.encode()).hexdigest() for x in (jwt, key)]
