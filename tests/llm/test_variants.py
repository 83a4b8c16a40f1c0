"""Spelling variants against all pairs of words, plainly compared."""

import random
import re
import zlib
from collections import Counter

import pytest
from repolith.llm import queries, variants
from repolith.llm.automata import Automaton


def plain_words(rows):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def plain(counts):
    out, forms = {}, {}
    for w, n in counts.items():
        close = [v for v in counts if one_apart(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 10 * n else None
        out[w] = [forms[w], None, n, len(close), counts[forms[w]] if forms[w] else None]
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def rows(df):
    got = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}
    assert len(out) == len(got)
    return out


def text_of(seed, words=3000):
    r = random.Random(seed)
    base = ["".join(r.choice("abñé") for _ in range(r.randint(7, 11))) for _ in range(40)]
    out = []
    for _ in range(words):
        w = base[min(int(r.expovariate(0.2)), 39)]
        k = r.randrange(len(w))
        if r.random() < 0.1:
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abñ") + w[k:], w[:k] + r.choice("abñ") + w[k + 1 :]])
        out.append(w.upper() if r.random() < 0.1 else w)
    return " ".join(out)


def test_words_of_documents_equal_plain_comparison(spark):
    data = [(k, text_of(k)) for k in range(6)] + [(6, None), (7, ""), (None, text_of(9)), (None, text_of(9)), (8, "short ones 123 only"), (9, "ÀÉÎaaaa ÀÉÎaaaa àéîaaaa àéîaaaa")]
    df = spark.createDataFrame([(*x, 1, "w") for x in data], "doc_id int, text string, n int, word string")
    want = plain(plain_words(data))
    assert rows(variants.group(df)) == want
    assert any(v[0] for v in want.values()) and any(v[3] == 0 for v in want.values())


def test_query_reads_the_table(spark):
    sf = "/root/testdata/sf0.001"
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts = plain_words(data)
    got = rows(queries.op11_variants(spark, sf))
    assert {w: v[2] for w, v in got.items()} == counts
    some = sorted(counts)[::97]
    for w in some:
        close = [v for v in counts if one_apart(w, v)]
        assert got[w][3] == len(close)


def test_forms_lead_to_a_root(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000}
    text = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items(), 1)]
    text = [(k, t) for k, t in text if zlib.crc32(f"{k}:{t.split()[0]}".encode()) % 31]
    got = rows(variants.group(spark.createDataFrame(text, "doc_id int, text string")))
    assert got == plain(plain_words(text)) and len({v[1] for v in got.values()}) < len(got)


@pytest.mark.parametrize("share", [20_000, 20])
def test_crowded_halves_and_very_long_words(spark, share):
    r = random.Random(3)
    words = {"hotstart" + "".join(r.choice("abñ") for _ in range(r.randint(0, 6))) for _ in range(400)}
    for base in ("a" * 700, "ab" * 300, "".join(r.choice("abc") for _ in range(900))):
        words |= {base, base + "a", base[1:], base[:300] + "c" + base[301:], base[:5] + "x" + base[5:]}
    counts = {w: r.choice([2, 3, 40, 900]) for w in words}
    want = {w: (v[3], *min((-counts[o], o) for o in counts if one_apart(w, o))) for w, v in plain(counts).items() if v[3]}
    got = variants.near(spark.createDataFrame(list(counts.items()), "word string, n long"), share).collect()
    assert {x["word"]: (x["n_near"], -x["best_n"], x["best"]) for x in got} == want and len(got) == len(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    assert variants.group(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert variants.group(none).count() == 0 and variants.near(spark.createDataFrame([], "word string, n long")).count() == 0


def test_automaton_numbers_words_and_is_minimal():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(500)})
    a = Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words))) and a.number("abcd") == a.number("") == -1
    ends = {}
    for w in words:
        for k in range(len(w) + 1):
            ends.setdefault(w[:k], set()).add(w[k:])
    assert len(a.arcs) == len({frozenset(v) for v in ends.values()})
    for w in words:
        later = {words.index(v) for v in words if one_apart(w, v) and (len(v) > len(w) or len(v) == len(w) and v > w)}
        assert set(a.one_more(w, 0)) == later and len(list(a.one_more(w, 0))) == len(later)
        assert {k for k in later if words[k].startswith(w[:2])} == set(a.one_more(w, min(2, len(w))))
    assert Automaton([]).number("a") == -1 and list(Automaton([]).one_more("a", 0)) == []
