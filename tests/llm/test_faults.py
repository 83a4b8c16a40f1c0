"""Cases that once went wrong."""

import hashlib
import time

import numpy as np

from repolith.llm import hashing, jaccard, langid, pieces, repeats, secret_scan, tokenids
from repolith.llm import queries as Q


def thue_morse(n):
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_of_a_pattern_have_different_hashes(spark):
    a, b = thue_morse(2048)
    raw = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    assert len(set(hashing.words(raw, np.array([0, len(raw)]))[0].tolist())) == 2
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.near_duplicates(docs).collect()} == {1, 2}
    path = Q.tokenizer_file("byte_bpe_50k.json")
    t = tokenids.tokenizer(path)
    got = {r["doc_id"]: r["n_tokens"] for r in tokenids.write_and_read(docs, path).collect()}
    assert got == {k: len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in ((1, a), (2, b))}
    path = Q.tokenizer_file("piece_bpe_32k.model")
    assert all(r["text"] == r["decoded"] for r in pieces.decode(pieces.encode(docs, path), path).collect())


def test_rows_of_one_id_lose_their_own_bytes_only(spark):
    p = "".join(f"shared passage {k} " for k in range(20))
    other = "".join(hashlib.md5(str(k).encode()).hexdigest() for k in range(13))[:400]
    rows = [(1, p + "one"), (2, p + "two"), (2, other), (2, p + "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], bytes(r["kept"]).decode()) for r in repeats.remove(df).collect())
    assert got == sorted([(1, p + "one"), (2, "two"), (2, other), (2, "two")])


def test_texts_without_letters_are_unknown(spark):
    docs = spark.createDataFrame([(k, f"the words of this text {k}", "en") for k in range(20)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "½ ² Ⅻ ①", "x"), (2, "12 _ 3", "y"), (3, "é", "z")], "doc_id long, text string, _guess string")
    got = {r["doc_id"]: (r["lang_pred"], r["_guess"]) for r in langid.predict(odd, langid.fit(docs)).collect()}
    assert got == {1: ("und", "x"), 2: ("und", "y"), 3: ("en", "z")}


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8)], "doc_id long, text string, _keep int")
    assert [tuple(r) for r in jaccard.drop_near_duplicates(df).collect()] == [(1, "a b c d e f", 7)]


def test_long_texts_in_stretches():
    p = pieces.pieces(Q.tokenizer_file("piece_bpe_32k.model"), 0.8)
    import pyarrow as pa

    text = " ".join(f"word{k}" for k in range(200_000)) + " " + "x" * 3_000_000 + " é" * 1000
    ids, n = pieces.encode_texts(p, pa.array([text, "tail"]), pieces.row_keys(np.arange(2), 3))
    assert b"".join(p.raw[p.begins[i] : p.begins[i] + p.sizes[i]].tobytes() for i in ids.tolist()) == (text + "tail").encode() and len(ids) == n.sum()
    encoder = tokenids.Encoder(Q.tokenizer_file("byte_bpe_50k.json"))
    text = " ".join(f"word{k}" for k in range(900_000))
    raw = np.frombuffer(text.encode(), np.uint8)
    places = hashing.cuts(raw, tokenids.SLICE)
    assert len(places) > 2 and all(raw[a] == 32 for a in places[1:-1])
    assert encoder.encode(raw, np.array([0, len(raw)]))[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_many_candidates_take_linear_time():
    text = " ".join(f"token=abcdefgh{k:06d} k{k:016d}z" for k in range(12_000))
    began = time.perf_counter()
    assert len(secret_scan.candidates(text)) == 24_000
    assert time.perf_counter() - began < 10
