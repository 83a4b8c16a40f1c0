"""Near duplicates among rows of null doc_id."""

from repolith.llm import jaccard


def test_null_ids(spark):
    base = [f"t{i}" for i in range(100)]
    far = lambda k: " ".join(base[k:] + [f"n{i}" for i in range(k)])
    rows = [(5, far(0)), (None, far(8)), (None, far(8)), (3, far(16)), (None, "alone in the world with its own words"), (None, None), (None, ""), (9, "another text that nothing else is near to")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == {(5, 96, 3), (3, 96, 3), (None, 96, 3), (None, 4, None), (None, 0, None), (9, 4, 9)}
    kept = jaccard.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept.collect()) == sorted((k or 0, t or "") for k, t in rows if k != 5)
