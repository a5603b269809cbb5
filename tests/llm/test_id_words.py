"""Words of the id files: the same ids as the whole text, with each piece of a word merged once."""

import random

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from panelwright.llm import idfiles

PATH = path("byte_bpe_50k.json")


class Counting:
    """The tokenizer, with the texts it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def ids(encode, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encode(texts)]


def test_new_words_skip_the_tokenizers_pattern():
    """Words of letters, digits and marks are cut here and merged by the model; only odd texts go through as they are."""
    encode = idfiles.Encoder(PATH)
    encode.tokenizer = Counting(whole := encode.tokenizer)
    rng = random.Random(3)
    words = ["".join(rng.choices("aeinorstéñß", k=9)) for _ in range(500)]
    texts = [" ".join(words), ", ".join(words) + ".", "\n".join(w + "!!" for w in words), "it's 12 (x_1) a'ts"]
    assert ids(encode, texts) == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert encode.tokenizer.texts == []
    assert ids(encode, ["a  b"]) == [whole.encode("a  b", add_special_tokens=False).ids]
    assert encode.tokenizer.texts == ["a  b"]


def test_plain_characters_are_cut_as_the_tokenizer_cuts_them():
    encode, whole = idfiles.Encoder(PATH), Tokenizer.from_file(PATH)
    plain = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if idfiles._PLAIN.fullmatch(c) and c != "\n"]
    texts = [f"a{c}a !{c}1 {c}" for c in plain]
    assert ids(encode, texts) == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts_and_a_small_memo(monkeypatch):
    monkeypatch.setattr(idfiles, "MEMO", 40)
    encode, whole = idfiles.Encoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(5)
    parts = ["a", "the", "ing", "S", "'s", "'", "'LL", "..", "_", "0", "é", "漢", "²", "ª", "́", "\x1c", "\x85", "　", "\t", "\r\n", "<|endoftext|>", "\n\n"]
    for _ in range(40):
        texts = ["".join(rng.choices(parts + [" "] * 8 + ["\n"] * 2, k=rng.randint(0, 25))) for _ in range(100)]
        assert ids(encode, texts) == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert len(encode.words) < 40 + 100 * 26
