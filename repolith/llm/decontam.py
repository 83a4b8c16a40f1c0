"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed mask looks at four words of a short stretch and ignores the rest, so a
substituted word breaks few seeds.  Hashes of the benchmark's seeds, at every word,
are joined with those of the documents, also at every word; each hit names a
document, an item and how they are aligned, and the aligned words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.llm.common import fresh, reduced, staged, text_of

#: Places within a stretch that a seed looks at.
MASKS = ((0, 1, 2, 3), (0, 1, 4, 6))
#: A window of so many aligned words (or a whole shorter item) of which SHARE percent are equal is a leak.
WINDOW, SHARE = 20, 80
#: An item of fewer words than EXACT_BELOW must be there word for word; one below LEAST_WORDS must be the whole text, as it stands in clean texts too.
EXACT_BELOW, LEAST_WORDS = 8, 4
#: Most seeds of a benchmark that are broadcast (24 bytes each); beyond it the join shuffles.
BROADCAST_SEEDS = 1_000_000
PUNCTUATION = ".,;:!?\"'()[]{}"


def words(text: Column) -> Column:
    """Lower-cased words without punctuation; none for null or blank."""
    t = F.btrim(F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \t-\r]+"))


def _seeds(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row (mask, hash, place) for each seed of the words ``_w``; places count from 0."""
    none = F.array().cast("array<struct<hash:bigint,place:int>>")

    def part(k: int, mask: tuple[int, ...]) -> Column:
        last = F.size("_w") - mask[-1]
        seed = lambda i: F.struct(F.xxhash64(F.lit(k), *[F.get("_w", i + o) for o in mask]).alias("hash"), i.alias("place"))
        return F.when(last > 0, F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), seed)).otherwise(none)

    parts = [part(k, mask) for k, mask in enumerate(MASKS)]
    return df.select(*keep, F.explode(F.concat(*parts)).alias("_s")).select(*keep, "_s.hash", "_s.place")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """One row for each document and item that it leaks: (doc_id, item_id, first_word, n_item_words, n_matched, best_window).

    Of several places the one with the most equal words in a window counts, then the
    earliest.  Null, empty and short texts leak nothing; other columns are not read.
    Items of 4 to 7 words leak only where all their words stand, those of 1 to 3 only where a
    text has no other word; items without a word don't leak.
    A repeated key counts once, with its best row.  Empty tables give an empty result.
    """
    all_items = benchmark.select(F.col(item).alias("item_id"), words(F.col("text").cast("string")).alias("_w"))
    items = all_items.where(F.size("_w") >= LEAST_WORDS)
    items = staged(items.groupBy("_w").agg(F.collect_set("item_id").alias("ids")).withColumn("item", F.xxhash64("_w")), "items")
    seeds = staged(_seeds(items, ["item"]).select("item", "hash", F.col("place").alias("item_place")).distinct(), "seeds")
    small = seeds.count() <= BROADCAST_SEEDS
    own = docs.select(F.col(key).cast("long").alias("doc_id"), text_of().alias("text"))
    found = _seeds(own.select("doc_id", words(F.col("text")).alias("_w")), ["doc_id"])
    hits = found.join(F.broadcast(seeds) if small else seeds, "hash")
    hits = hits.select("doc_id", "item", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    hits = staged(hits, "hits")

    ids = hits.select("doc_id").distinct()
    texts = reduced(own, ids, "doc_id").join(ids, "doc_id").select("doc_id", words(F.col("text")).alias("_d"))
    both = hits.join(texts, "doc_id").join(F.broadcast(items) if small else items, "item")
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("_w"), F.size("_d") - F.col("shift")) - 1
    equal = F.transform(F.sequence(first, last), lambda i: F.when(F.get("_w", i) == F.get("_d", i + F.col("shift")), 1).otherwise(0))
    both = both.withColumn("_e", F.when(last >= first, equal)).withColumn("_n", F.least(F.lit(WINDOW), F.size("_w")))
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_e") - F.col("_n") + 1, F.lit(1))), lambda s: F.aggregate(F.slice("_e", s, F.col("_n")), F.lit(0), lambda a, x: a + x))
    both = both.withColumn("best_window", F.when(F.size("_e") >= F.col("_n"), F.array_max(sums)).otherwise(0)).where(100 * F.col("best_window") >= F.when(F.col("_n") < EXACT_BELOW, 100).otherwise(SHARE) * F.col("_n"))
    rows = both.select("doc_id", F.explode("ids").alias("item_id"), F.col("shift").alias("first_word"), F.size("_w").alias("n_item_words"), F.aggregate("_e", F.lit(0), lambda a, x: a + x).alias("n_matched"), "best_window")
    short = F.size("_w").between(1, LEAST_WORDS - 1)
    brief = own.select("doc_id", words(F.col("text")).alias("_w")).where(short).join(all_items.where(short), "_w")
    rows = rows.unionByName(brief.select("doc_id", "item_id", F.lit(0).alias("first_word"), *[F.size("_w").alias(c) for c in ("n_item_words", "n_matched", "best_window")]))
    best = F.max_by(F.struct("first_word", "n_item_words", "n_matched", "best_window"), F.struct("best_window", "n_matched", -F.col("first_word"))).alias("b")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item of the benchmark.

    All rows of a leaking doc_id go; rows of null doc_id, and null, empty and short texts, stay.
    """
    name = fresh("_bad", docs)
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id") == F.col(name), "left_anti")
