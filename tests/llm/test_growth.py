"""The language model's shuffled path with groups of several shards."""

from pyspark.sql import functions as F

from repolith.llm import lm


def test_groups_of_shards_give_the_scores_of_the_broadcast_filter(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 64)
    monkeypatch.setattr(lm, "GROUPS", 3)
    monkeypatch.setattr(lm, "FREQUENT", 4)
    monkeypatch.setattr(lm, "LOOKUPS", 50)
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % (7 + k)}" for j in range(k % 40))) for k in range(120)], "doc_id long, text string").repartition(6)
    rows = lambda size: {r["doc_id"]: (round(r["score"], 9), round(r["base_score"], 9)) for r in lm.score(docs, F.col("doc_id") % 7 != 2, broadcast_bytes=size).collect()}
    asked, shuffled = [], lm._shuffled

    def look(texts, lfbf, shards, n, v):
        asked.append(shards)
        return shuffled(texts, lfbf, shards, n, v)

    monkeypatch.setattr(lm, "_shuffled", look)
    want = rows(1 << 30)
    assert not asked and rows(0) == want and min(asked) > 2 * lm.GROUPS
