"""Quality rules by weak supervision: rules vote, EM weighs them, a posterior decides.

All work is DataFrame expressions.  A row's measures come from higher-order
functions over its own words, so nothing but vote patterns is ever shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.llm.common import staged, text_of

WINDOW = 3
ITERATIONS = 25
#: Bounds that keep the estimates of a, P(vote good | good), and b, P(vote bad | bad),
#: off 0 and 1; a stays on the better side of a coin, so good and bad don't change places.
LEAST_A, MAX_A, MIN_B, MAX_B = 0.6, 0.999, 0.01, 0.95


#: Space and 0x09-0x0D, which separate words.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _count(col: str, chars: str) -> Column:
    """How many characters of ``col`` are among a few one-byte ``chars``."""
    left = F.col(col)
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.length(col) - F.length(left)).cast("long")


def _places(side: str, shift: int) -> Column:
    return F.transform("_r", lambda p: p[side]["i"] + shift)


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts that the rules look at, one row for each row of ``docs``.

    Null and empty texts count zero everywhere; repeated keys keep their rows.
    Repeated windows are found by sorting a row's own windows and comparing
    neighbours; each step is a column of its own, so it is computed once a row.
    """
    n = F.size("_w")
    d = docs.select(F.col(key), text_of(text).alias("_t")).withColumn("_b", F.btrim("_t", F.lit(SPACES)))
    d = d.withColumn("_w", F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", "[ \t-\r]+")))
    d = d.withColumn("_l", F.split("_t", "\n"))
    m = F.greatest(n - (WINDOW - 1), F.lit(0))
    z = F.arrays_zip(F.slice("_w", F.lit(1), m).alias("a"), F.slice("_w", F.lit(2), m).alias("b"), F.slice("_w", F.lit(3), m).alias("c"), F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))).alias("i"))
    d = d.withColumn("_z", F.when(n >= WINDOW, F.sort_array(z)))
    k = F.size("_z") - 1
    d = d.withColumn("_p", F.when(k > 0, F.arrays_zip(F.slice("_z", F.lit(1), k).alias("x"), F.slice("_z", F.lit(2), k).alias("y"))))
    same = lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"])
    d = d.withColumn("_r", F.filter("_p", same))
    covered = F.flatten(F.array(*[_places(side, o) for side in "xy" for o in range(WINDOW)]))
    lines = F.filter("_l", lambda x: F.btrim(x, F.lit(SPACES)) != "")
    d = d.withColumn("_l", lines)
    return d.select(
        key,
        n.cast("long").alias("n_words"),
        (F.length("_t") - _count("_t", SPACES)).cast("long").alias("word_chars"),
        _count("_t", SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.coalesce(F.size(F.array_distinct(covered)).cast("long"), F.lit(0)).alias("n_repeat_words"),
        F.regexp_count("_t", F.lit("[A-Z]{2}")).cast("long").alias("n_capital_pairs"),
        _count("_t", "!").alias("n_exclaim"),
        (F.size("_w") - F.regexp_count("_b", F.lit("(?<![^ \t-\r])[^\\p{L} \t-\r]+(?![^ \t-\r])"))).cast("long").alias("n_letter_words"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def rules() -> dict[str, Column]:
    """Name to vote: 1 good, 0 bad, null abstains.  Shares are of words unless said otherwise."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    enough = F.col("n_words") >= 20
    return {
        "length": _vote(F.col("n_words") < 5, F.col("n_words") >= 50),
        "symbols": _vote(F.col("n_symbols") / n > 0.15, F.col("n_symbols") / n < 0.05),
        "letters": _vote(F.col("n_letter_words") / n < 0.75, F.col("n_letter_words") / n > 0.92),
        "word_length": _vote((F.col("word_chars") / n < 2.5) | (F.col("word_chars") / n > 14), (F.col("word_chars") / n).between(3, 10)),
        "dup_lines": _vote(enough & (F.col("n_dup_lines") / lines > 0.3), enough & (F.col("n_dup_lines") / lines < 0.1)),
        "repeats": _vote(enough & (F.col("n_repeat_words") / n > 0.35), enough & (F.col("n_repeat_words") / n < 0.15)),
        "capitals": _vote(enough & (F.col("n_capital_pairs") / chars > 0.2), enough & (F.col("n_capital_pairs") / chars < 0.05)),
        "exclaim": _vote(enough & (F.col("n_exclaim") / n > 0.2), enough & (F.col("n_exclaim") / n < 0.05)),
    }


def _posterior(names: list[str], prior: float, acc: dict[str, tuple[float, float]]) -> Column:
    """P(good | votes) for P(vote good | good), P(vote bad | bad) in ``acc``."""
    logit: Column = F.lit(math.log(prior / (1 - prior)))
    for x in names:
        a, b = acc[x]
        logit = logit + F.when(F.col(x) == 1, F.lit(math.log(a / (1 - b)))).when(F.col(x) == 0, F.lit(math.log((1 - a) / b))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def estimate(votes: DataFrame, names: list[str], iterations: int = ITERATIONS) -> tuple[float, dict[str, tuple[float, float]]]:
    """EM for the two accuracies of each rule, over counts of vote patterns.

    There are at most 3 ** len(names) patterns, however large the corpus; each
    round is one aggregate that returns one row.  An empty table leaves the start values.
    """
    patterns = staged(votes.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n")), "patterns")
    prior, acc = 0.9, dict.fromkeys(names, (MAX_A, 0.25))
    for _ in range(iterations):
        p = patterns.withColumn("q", _posterior(names, prior, acc))
        sums = [F.sum("n").alias("all"), F.sum(F.col("n") * F.col("q")).alias("good")]
        for x in names:
            for v in (0, 1):
                hit = F.when(F.col(x) == v, F.col("n")).otherwise(0.0)
                sums += [F.sum(hit * F.col("q")).alias(f"{x}_g{v}"), F.sum(hit * (1 - F.col("q"))).alias(f"{x}_b{v}")]
        r = p.agg(*sums).first()
        if not r["all"]:
            break
        prior = min(0.99, max(0.01, (r["good"] + 8) / (r["all"] + 10)))
        right = {x: ((r[f"{x}_g1"] + 1) / (r[f"{x}_g1"] + r[f"{x}_g0"] + 1), (r[f"{x}_b0"] + 1) / (r[f"{x}_b0"] + r[f"{x}_b1"] + 4)) for x in names}
        acc = {x: (min(MAX_A, max(LEAST_A, a)), min(MAX_B, max(MIN_B, b))) for x, (a, b) in right.items()}
    return prior, acc


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``docs``: measures, votes, ``quality`` (posterior) and ``kept``.

    ``base_failed`` holds for fewer than 50 words or when over half the words are
    repeated; such rows are never kept.  The rest is kept from ``threshold`` up.
    Extra columns of ``docs`` are not read; an empty table gives an empty result.
    """
    votes = rules()
    m = staged(measures(docs, text, key).withColumns({f"vote_{k}": v for k, v in votes.items()}), "votes")
    names = [f"vote_{k}" for k in votes]
    prior, acc = estimate(m, names)
    m = m.withColumn("quality", _posterior(names, prior, acc))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))
