"""What the tokenizer is asked for, and ids of texts whose units are asked for together."""

import json
import random

import numpy as np
from repolith.llm import queries as Q
from repolith.llm import tokenids


class Asked:
    """A tokenizer that counts the calls and the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls, self.texts, self.chars = tokenizer, 0, 0, 0

    def encode_batch_fast(self, texts, **options):
        self.calls, self.texts, self.chars = self.calls + 1, self.texts + len(texts), self.chars + sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def rows_of(texts):
    data = [x.encode() for x in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def same(encoder, plain, texts):
    ids, sizes = encoder.encode(*rows_of(texts))
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [x.ids for x in plain.encode_batch_fast(texts, add_special_tokens=False)]


def test_words_are_asked_for_once_whatever_marks_follow():
    encoder = tokenids.Encoder(Q.tokenizer_file("byte_bpe_50k.json"))
    asked = encoder.tokenizer = Asked(encoder.tokenizer)
    words = [f"w{'é' * (k % 2)}ord{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}" for k in range(1000)]
    texts = [" " + " ".join(w + mark for w in words) for mark in ("", ".", ",", "!", "...", ")", "'s")]
    same(encoder, asked.tokenizer, texts)
    assert asked.chars < 1.1 * sum(len(w) + 1 for w in words) and asked.texts < 10
    before = asked.chars
    same(encoder, asked.tokenizer, texts[::-1])
    assert asked.chars == before


def test_tasks_of_a_run_share_what_is_learned():
    path = Q.tokenizer_file("byte_bpe_50k.json")
    first = tokenids.encoder_of(path, "a")
    assert tokenids.encoder_of(path, "a") is first
    assert tokenids.encoder_of(path, "b") is not first


def test_forgotten_units_are_learned_again(monkeypatch):
    monkeypatch.setattr(tokenids, "REMEMBERED_IDS", 20)
    encoder = tokenids.Encoder(Q.tokenizer_file("byte_bpe_50k.json"))
    for k in range(5):
        same(encoder, encoder.tokenizer, [f"some words, é and more of turn {k}!", "", f"xyzzy{k} qwertz."])
        assert encoder.used < 100


def test_ids_of_units_equal_those_of_texts(tmp_path):
    from tokenizers import Tokenizer

    path = Q.tokenizer_file("byte_bpe_50k.json")
    parts = "a|b|s|s.|ll|'|'s|'ll|é|ÿ|×|÷|1|½|٣|中|я|́|😀|ſ|Ā|.|,,|!|...|&&|_|<| |  |\n|\n\n|\t|\x0b|\x1c|\x85|\xa0|　|\x00|<%endoftext%>|<%endof|text%>".replace("%", "\0\0").split("|")
    parts = [x.replace("\0\0", "|") for x in parts]
    # added tokens that units side by side may form, and some that hold a unit's bounds
    changed = json.loads(open(path).read())
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}
    changed["added_tokens"] += [{"id": 50257, "content": "a b", **plain}, {"id": 50258, "content": "s.", **plain, "lstrip": True}]
    (tmp_path / "changed.json").write_text(json.dumps(changed))
    pick = random.Random(5)
    for name, rounds in ((path, 20), (str(tmp_path / "changed.json"), 20)):
        encoder, whole = tokenids.Encoder(name), Tokenizer.from_file(name)
        for _ in range(rounds):
            some = pick.sample(parts, pick.randint(2, len(parts))) + ["a", " b"]
            same(encoder, whole, ["".join(pick.choices(some, k=pick.choice([0, 1, 2, 3, 8, 30]))) for _ in range(100)])
