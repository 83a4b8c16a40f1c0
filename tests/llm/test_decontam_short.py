"""Leaks of short items."""

import itertools

from repolith.llm import decontam


def test_short_items_leak_at_any_place(spark):
    ten, five, three = [f"w{i}" for i in range(10)], "who wrote the old song", "yes or no"
    docs, want = [(0, f"pre {five.upper()}, post"), (1, "who wrote the new song"), (2, three), (3, f"{three} but"), (4, "Yes, or NO!"), (5, ""), (6, None), (7, "...")], {(0, 2), (2, 3), (4, 3)}
    for pad in (0, 1):
        for a, b in itertools.combinations(range(10), 2):
            words = ["zz" if k in (a, b) else w for k, w in enumerate(ten)]
            want.add((len(docs), 1))
            docs.append((len(docs), " ".join(["pre"] * pad + words + ["post"])))
    bench = spark.createDataFrame([(1, " ".join(ten)), (2, five), (3, three), (4, ""), (5, None), (6, "!")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == want
