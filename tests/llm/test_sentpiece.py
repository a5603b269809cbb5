import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import sentpiece as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = S.Model(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "  ", "The thing, worthless.\nThe  end ", "été ﬁ 漢字 \U0001f600\tx", "a" * 300, "x▁y ▁", "12 345", "\n\n a", "naïve\u0000b"]


def ids(raw):
    return [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]


def test_rate_zero_is_the_library():
    for text in TEXTS:
        if S.MARK not in text and "\0" not in text:
            assert ids(S.encode_texts(MODEL, [text], [3], rate=0)[0]) == LIBRARY.encode(text), text


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("the inringad,.\né漢 ▁X"), max_size=80), st.integers(0, 9), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_lossless_and_equal_to_the_agenda(text, key, rate):
    raw = S.encode_texts(MODEL, [text], [key], rate=rate)[0]
    assert S.decode_ids(MODEL, raw) == text
    words = list(dict.fromkeys(S._SPLIT.findall(" " + text)))
    for v in range(2):
        assert S.together(MODEL, words, [v] * len(words), 5, rate) == [S.agenda(MODEL, w, v, 5, rate) for w in words]


def test_dropout_varies_by_key_and_repeats_by_seed():
    text = "worthless disgusting attention thinking international " * 20
    a = S.encode_texts(MODEL, [text], [1], rate=0.3)[0]
    assert a == S.encode_texts(MODEL, [text], [1], rate=0.3)[0]
    assert len({S.encode_texts(MODEL, [text], [1], seed=s, rate=0.3)[0] for s in range(5)}) == 5
    assert len({tuple(S.together(MODEL, [" international"], [v], 7, 0.3)) for v in range(40)}) > 5
    assert len(S.encode_texts(MODEL, [text], [1], rate=1.0)[0]) > len(a) > len(S.encode_texts(MODEL, [text], [1], rate=0)[0])


def test_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "y"), (None, "the", None), (1, "again", "z"), (1, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = S.encode(docs, PATH)
    back = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in S.decode(encoded, PATH).collect())
    assert back == sorted((-1 if i is None else i, t or "") for i, t, _ in rows)
    digest = S.encode(docs, PATH, digest=True).collect()
    assert all(r.lossless for r in digest) and len(digest) == len(rows)
    assert {r.n_pieces for r in digest if r.doc_id in (0, 99)} == {0}
    assert S.encode(docs.limit(0), PATH).count() == 0


def test_model_of_another_kind_is_refused():
    with pytest.raises(Exception):
        S.Model("/nonexistent.model")


def test_lookup_reads_on_only_where_a_slot_holds_another_pair():
    model = S.Model(public_tokenizers.path("piece_bpe_32k.model"))
    table, read = model.table, []

    class Seen:
        def __getitem__(self, at):
            read.append(at.size)
            return table[at]

    model.table = Seen()
    rng = np.random.default_rng(3)
    known = np.array(list(model.merge)[:3000])
    left = np.concatenate([known >> 16, rng.integers(-5, 32_000, 3000)]).reshape(60, 100)
    right = np.concatenate([known & 65535, rng.integers(-5, 32_000, 3000)]).reshape(60, 100)
    rank, piece = model.lookup(left, right)
    for a, b, r, p in zip(left.ravel().tolist(), right.ravel().tolist(), rank.ravel().tolist(), piece.ravel().tolist()):
        assert (r, p) == (model.merge.get(a << 16 | b, (-1, -1)) if a >= 0 and b >= 0 else (-1, -1))
    assert sum(read) < 1.5 * left.size < model.probes * left.size


def test_every_occurrence_draws_its_own_skips():
    word = " worthless"
    text = word[1:] + word * 599
    raw = S.encode_texts(MODEL, [text, text, text], [1, 2, 1])
    assert raw[0] == raw[2] != raw[1]
    keys = S.occurrences([1], np.array([600]), S.SEED)
    apart = [S._agenda(MODEL, word, int(k), S.RATE) for k in keys]
    assert b"".join(apart) == raw[0]
    assert len(set(apart)) > 4
    merges = len(word) - len(ids(S.agenda(MODEL, word, 0, 0, 0.0)))
    assert abs((S._gaps(keys, 0, S.RATE) >= merges).mean() - (1 - S.RATE) ** merges) < 0.08


def test_occurrences_equal_the_agenda_whatever_is_memoised():
    texts = [t * 7 for t in TEXTS] + ["international " * 30, "b" * 60 + " é漢" * 9]
    for rate in (0.0, 0.1, 0.6, 1.0):
        memo, alone = S.Memo(), [S.encode_texts(MODEL, [t], [i], rate=rate)[0] for i, t in enumerate(texts)]
        for _ in range(2):
            assert S.encode_texts(MODEL, texts, list(range(len(texts))), rate=rate, memo=memo) == alone
        for i, t in enumerate(texts):
            words = S._SPLIT.findall(" " + t) if t else []
            drawn = S.occurrences([i], np.array([len(words)]), S.SEED)
            assert b"".join(S._agenda(MODEL, w, int(k), rate) for w, k in zip(words, drawn)) == alone[i]
