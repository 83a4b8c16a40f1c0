"""Spelling variants: words one error apart, through forward and backward automata.

Two words that differ by one inserted, deleted or replaced code point share the first half
of the shorter one, or its second half.  Words are dealt out by their halves; in each share a
forward automaton holds the words and a backward one the words reversed.  A word's half is
matched exactly in either direction, the rest completed with one error; words are told by their
perfect-hash numbers.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.llm.automata import Automaton
from repolith.llm.common import discard, staged

LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: A run in so many, told by a hash of document and run, loses a code point.
DAMAGED = 31
#: Words counted in a task before their counts are handed on.
HELD = 200_000
#: Rows of a share, that is one task's automata; a half that more words have is cut further.
SHARE = 20_000
#: What remains of a word besides its matched parts is at most so long, else it is cut further.
REST = 64
_LOWER = {c: c + 32 for c in range(65, 91)}


def _counted(key: str, text: str, least: int):
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}").findall

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        crc = zlib.crc32
        for batch in batches:
            for i, t in zip(batch.column(key).to_pylist(), batch.column(text), strict=True):
                start = crc(f"{'' if i is None else i}:".encode())
                for run, n in Counter(runs(t.as_py() or "")).items():
                    word = run.lower() if run.isascii() else run.translate(_LOWER)
                    h = crc(word.encode(), start)
                    if not h % DAMAGED:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    return of


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters of whole texts with ``least`` code points or more, found ``count`` times or more.

    Only A-Z are lower-cased.  Every 31st run of a document, by a hash, loses one code point
    first.  A null text has no words, a null key counts as an empty one; rows of one key count
    each; an empty table gives an empty one; other columns don't matter.  A very long run is a word.
    """
    d = docs.select(F.col(key).cast("string").alias("_k"), F.col(text).cast("string").alias("_t"))
    found = d.mapInArrow(_counted("_k", "_t", least), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


# A row of the dealt table: a word, the lengths ``p`` and ``s`` of its matched prefix and suffix, ``back`` if it goes to
# the backward automaton, ``ask`` if it is searched for there (else it can be found only), ``free``: a word that shares
# so long a prefix is found elsewhere.  A word asks for words of its own length and for those one longer.


def _cut(rows: DataFrame) -> DataFrame:
    """Each row twice or more: with the first and with the second half of its rest matched too."""
    rest = F.length("word") - F.col("p") - F.col("s")
    half = lambda r: F.floor(r / 2).cast("int")
    ways = lambda back: F.transform(F.array(F.lit(0), F.lit(1)), lambda less: F.struct(F.lit(back).alias("second"), half(rest - less).alias("g"), (rest - less).alias("r"), (half(rest - less) == half(rest)).alias("own"), less.alias("less")))
    d = rows.withColumn("_w", F.explode(F.concat(ways(False), ways(True))))
    d = d.withColumn("_g", F.when(F.col("_w.second"), F.col("_w.r") - F.col("_w.g")).otherwise(F.col("_w.g")))
    own = F.when(F.col("_w.second"), F.col("_g") == rest - half(rest)).otherwise(F.col("_g") == half(rest))
    d = d.where((F.col("_w.less") == 0) | (~own & (F.col("_w.r") >= 0)))  # where both lengths give the same half, one row serves
    return d.select(
        "word",
        "n",
        (F.col("p") + F.when(F.col("_w.second"), 0).otherwise(F.col("_g"))).cast("int").alias("p"),
        (F.col("s") + F.when(F.col("_w.second"), F.col("_g")).otherwise(0)).cast("int").alias("s"),
        F.coalesce("back", F.col("_w.second")).alias("back"),
        (F.col("ask") & (F.col("_w.less") == 0)).alias("ask"),
        F.when(F.col("_w.second"), F.col("p") + F.col("_w.g")).otherwise(F.col("free")).cast("int").alias("free"),
    )


def _halves() -> Column:
    return F.xxhash64("back", "p", "s", F.substring("word", F.lit(1), F.col("p")), F.substring("word", F.length("word") - F.col("s") + 1, F.col("s")))


def _dealt(counted: DataFrame, most: int, rest: int) -> DataFrame:
    """All rows with ``half``, the hash of what must match; no half has more than ``most`` words, unless next to nothing is left to match.

    Each round shortens what is left of every row it cuts, so the rounds are at most as many as halvings of the longest word.
    """
    start = counted.select("word", "n", F.lit(0).alias("p"), F.lit(0).alias("s"), F.lit(None).cast("boolean").alias("back"), F.lit(True).alias("ask"), F.lit(None).cast("int").alias("free"))
    done, now = [], staged(_cut(start).withColumn("half", _halves()), "halves")
    used = [now]
    while True:
        left = F.length("word") - F.col("p") - F.col("s")
        large = now.groupBy("half").agg(F.count(F.lit(1)).alias("_n"), F.max(left).alias("_r")).where(((F.col("_n") > most) & (F.col("_r") > 2)) | (F.col("_r") > rest)).select("half")
        large = staged(large, "large")
        used.append(large)
        if large.isEmpty():
            break
        done.append(now.join(large, "half", "left_anti"))
        now = staged(_cut(now.join(large, "half", "left_semi")).withColumn("half", _halves()), "halves")
        used.append(now)
    for d in done:
        now = now.unionByName(d)
    dealt = staged(now, "dealt")
    discard(*used)
    return dealt


def _entry(word: str, p: int, s: int, back: bool) -> tuple[str, int]:
    """What the automaton holds for a word, and how much of it must match exactly.

    Of a very long word, the matched parts stand as a digest.
    """
    if len(word) > 2 * REST:
        head = f"{hashlib.sha256(f'{p}:{s}:{word[:p]}:{word[len(word) - s :]}'.encode()).hexdigest()}"
        return head + word[p : len(word) - s], len(head)
    return (word[::-1], s) if back else (word, p)


def _share(rows: pa.Table) -> pa.Table:
    """For each word of a share: how many words of it are one error away, and the most frequent of them."""
    found: dict[str, list] = {}

    def note(word: str, other: str, n: int) -> None:
        x = found.get(word)
        if x is None:
            found[word] = [1, -n, other]
        else:
            x[0] += 1
            if (-n, other) < (x[1], x[2]):
                x[1], x[2] = -n, other

    columns = [rows.column(c).to_pylist() for c in ("word", "n", "p", "s", "back", "ask", "free")]
    for way in (False, True):
        part = [(*_entry(w, p, s, back), w, n, p, s, ask, free) for w, n, p, s, back, ask, free in zip(*columns, strict=True) if back == way]
        of = {e: (w, n) for e, _, w, n, *_ in part}
        order = sorted(of)
        automaton, at = Automaton(order), [of[e] for e in order]
        for entry, exact, word, n, p, s, ask, free in part:
            if not ask:
                continue
            for k in automaton.one_more(entry, exact):
                other, m = at[k]
                # a share holds words of other halves too: what they have in common counts once, for its own half
                if other.startswith(word[:p]) and other.endswith(word[len(word) - s :]) and (free is None or not other.startswith(word[:free])):
                    note(word, other, m)
                    note(other, word, n)
    counts = list(found.values())
    return pa.table([pa.array(list(found), pa.string()), pa.array([x[0] for x in counts], pa.int64()), pa.array([-x[1] for x in counts], pa.int64()), pa.array([x[2] for x in counts], pa.string())], ["word", "n_near", "best_n", "best"])


def near(counted: DataFrame, share: int = SHARE, rest: int = REST) -> DataFrame:
    """(word, n_near, best, best_n) of the words of (word, n) that have others one error away.

    Words are taken as distinct; an empty table gives an empty one.  A half that more than
    ``share`` words have is cut by halves of what is left, so that no task gets them all.
    """
    dealt = _dealt(counted, share, min(rest, REST))
    shares = max(1, math.ceil(dealt.count() / share))
    found = dealt.groupBy(F.pmod("half", F.lit(shares)).alias("share")).applyInArrow(_share, "word string, n_near bigint, best_n bigint, best string")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best"))).alias("b"))
    out = staged(found.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n")), "near")
    discard(dealt)
    return out


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form), by doubling: the way to the last form halves each round."""
    now = staged(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.alias("a").join(now.select(F.col("word").alias("_w"), F.col("root").alias("_r")).alias("b"), F.col("root") == F.col("_w"), "left")
        then = staged(step.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_more")), "roots")
        discard(now)
        if then.where("_more").isEmpty():
            return then.select("word", "root")
        now = then


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the texts.

    A word's form is the most frequent word one error away (ties: the first in code-point
    order), where that is ``times`` as frequent or more; else null.  Its root is where forms
    lead to, itself if it has none.  Texts, keys and tables as ``words`` says.
    """
    counted = staged(words(docs, key, text), "words")
    close = near(counted)
    found = counted.join(close, "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    found = staged(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "found")
    discard(counted, close)
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
