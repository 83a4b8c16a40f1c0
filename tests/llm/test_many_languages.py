"""Samples of a language column with many values."""

from repolith.llm import langid


def test_every_language_is_sampled(spark):
    junk = [(k, f"junk{k:05d}", "some text") for k in range(1200)]
    df = spark.createDataFrame([*junk, *[(2000 + k, "zz", f"real text {k}") for k in range(50)], (3000, None, "x"), (3001, "zz", "123")], "doc_id long, lang string, text string")
    got = {r["lang"]: r["count"] for r in langid.sampled(df).groupBy("lang").count().collect()}
    assert got == {**{x: 1 for _, x, _ in junk}, "zz": 50}
    assert langid.fit(df.where("lang = 'zz'")).langs == ["zz"] and langid.fit(df.where("lang is null")).langs == []
