"""Ids of texts that hold the tokenizer's added token."""

import zlib

import numpy as np
from repolith.llm import queries as Q
from repolith.llm import tokenids


def test_added_tokens(spark):
    from tokenizers import Tokenizer

    path = Q.tokenizer_file("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    end = "<|endoftext|>"
    texts = ["plain words", f"a  {end} é b", f"x{end}{end}\n y", "<|endof", "text|>", end, None, f"  {end}  {end}", "the end"]
    assert 50256 in plain.encode(end, add_special_tokens=False).ids
    start, want = 0, []
    for k, x in enumerate(texts):
        ids = [*plain.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in tokenids.write_and_read(df, path).collect()) == want
