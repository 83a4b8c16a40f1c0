"""Each stage of the pipeline on odd rows, and stage by stage against plain versions."""

import re

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from repolith.llm import langid
from repolith.llm import queries as Q

from . import brute
from .test_documents import SF, rows

WORDS = "the quick brown fox jumps over the lazy dog while many other animals look at it from afar and wonder why".split()
LONG = " ".join(f"{w}{k}" for k in range(8000) for w in ("word", "other", "third"))


@pytest.fixture(scope="module")
def odd(spark):
    """Columns whose names stages use for themselves, nulls in every column, empty, long and repeated texts."""
    kind = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = " ".join(WORDS)
    data = [(1, text), (2, text), (3, None), (4, ""), (5, "123 !!! 456"), (6, LONG), (None, text), (None, None), (7, "mail a.b@c.de or +49 170 1234567 now " + text), (7, "mail a.b@c.de or +49 170 1234567 now " + text), (8, "one")]
    d = spark.createDataFrame([(i, t, "en" if i != 2 else None, None, len(t or "")) for i, t in data], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d = d.select(*[F.col(f.name).cast(f.dataType) for f in kind.fields])
    for name in ("_rest", "_t", "lang_pred", "score", "_bad", "_keep", "pieces", "decoded", "_w", "hash"):
        d = d.withColumn(name, F.lit(1))
    return d.cache()


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_stages_on_odd_rows(spark, odd):
    stages = dict(P.STAGES)
    got = stages["language_id"](spark, odd, SF)
    assert got.schema == odd.schema and set(ids(got)) <= {1, 2, 6, 7, 8, None} and {1, 2, 7} <= set(ids(got))
    got = stages["jaccard_join"](spark, odd, SF)
    assert got.columns == odd.columns and ids(got) == sorted([1, 3, 4, 5, 6, 7, 7, 8, None, None], key=str)
    got = stages["decontamination"](spark, odd, SF)
    assert got.schema == odd.schema and ids(got) == ids(odd)
    got = {r["doc_id"]: r for r in stages["pii"](spark, odd, SF).where("doc_id is not null").collect()}
    assert "a.b@c.de" not in got[7]["text"] and "1234567" not in got[7]["text"] and got[7]["n_chars"] == len(got[7]["text"])
    assert got[1]["text"] == " ".join(WORDS) and got[3]["text"] is None and got[3]["n_chars"] is None and got[6]["text"] == LONG
    got = stages["pieces"](spark, odd, SF)
    assert got.columns == ["doc_id", "lang", "source", "pieces"] and got.count() == odd.count()
    sizes = {r["doc_id"]: len(r["pieces"]) for r in got.where("doc_id is not null").collect()}
    assert sizes[3] == sizes[4] == 0 and sizes[6] > 24_000
    twice = [tuple(r["pieces"]) for r in got.where("doc_id = 7").collect()]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_stages_on_empty_tables(spark, odd):
    for name, stage in P.STAGES:
        out = stage(spark, odd.limit(0), SF)
        assert out.count() == 0 and (name == "pieces" or out.columns == odd.columns), name
    bare = odd.select("doc_id", "text")
    assert dict(P.STAGES)["pii"](spark, bare, SF).columns == ["doc_id", "text"]
    assert dict(P.STAGES)["pieces"](spark, bare, SF).where("lang is null and source is null").count() == odd.count()
    assert dict(P.STAGES)["language_id"](spark, odd.withColumn("lang", F.lit(None).cast("string")), SF).count() == 0


def leaks(docs, items):
    """doc_ids that a plain comparison of all alignments finds."""
    clean = lambda t: re.findall(r"[^ \t-\r]+", "".join(c for c in (t or "").lower() if c not in ".,;:!?\"'()[]{}"))
    wanted, out = [clean(t) for _, t in items], set()
    for d, t in docs:
        words = clean(t)
        places = {}
        for k, w in enumerate(words):
            places.setdefault(w, []).append(k)
        for item in wanted:
            n = min(20, len(item))
            if 0 < len(item) < 4:
                if words == item:
                    out.add(d)
                continue
            hits = {}
            for j, w in enumerate(item):
                for k in places.get(w, ()):
                    hits.setdefault(k - j, set()).add(j)
            for shift, own in hits.items():
                first, last = max(0, -shift), min(len(item), len(words) - shift)
                share = 100 if n < 8 else 80
                if n and any(100 * len(own & set(range(s, s + n))) >= share * n for s in range(first, last - n + 1)):
                    out.add(d)
    return out


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(P.STAGES)
    known = {r["doc_id"]: r for r in docs.collect()}
    told = stages["language_id"](spark, docs, SF).cache()
    model = langid.fit(docs)
    want = set()
    for i, r in known.items():
        lang, score = model.predict(r["text"])
        if lang != langid.UNKNOWN and score >= P.LEAST_LANGUAGE_SCORE:
            want.add(i)
    assert set(ids(told)) == want and len(want) > 0.8 * len(known)
    one = stages["jaccard_join"](spark, told, SF).cache()
    near = brute.near(rows(told))
    assert set(ids(one)) == {d for d, (_, c) in near.items() if d == c} and one.count() < told.count()
    clean = stages["decontamination"](spark, one, SF).cache()
    bad = leaks(rows(one), rows(spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").withColumnRenamed("item_id", "doc_id")))
    assert set(ids(clean)) == set(ids(one)) - bad and bad
    masked = stages["pii"](spark, clean, SF).cache()
    before = dict(rows(clean))
    for r in masked.collect():
        assert not [s for s in brute.pii(r["text"]) if s[0] == "email"]
        assert brute.pii(before[r["doc_id"]]) or r["text"] == before[r["doc_id"]] or re.search("<[A-Z]+>", r["text"])
        assert r["n_chars"] == len(r["text"])
    done = stages["pieces"](spark, masked, SF)
    last = {r["doc_id"]: list(r["pieces"]) for r in P.run(spark, SF).collect()}
    assert {r["doc_id"]: list(r["pieces"]) for r in done.collect()} == last and len(last) == clean.count()
    assert Q.tokenizer_file("piece_bpe_32k.model")
