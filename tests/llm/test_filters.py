"""Rules, site quality and toxicity."""

import random
from collections import Counter

import pytest

from panelwright.llm import rules, sitequality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_words int, kept string"
SENTENCE = "The thing of the words and a word to be in the house with it for all on this day."


def corpus():
    draw = random.Random(3)
    words = "the of and to in a is that for was house tree river stone light paper window garden morning winter".split()
    rows = []
    for i in range(120):
        text = " ".join(draw.choice(words) + ("." if draw.random() < 0.1 else "") for _ in range(150))
        if i % 6 == 0:
            text = " ".join(w.upper() + "###" for w in text.split())
        rows.append((i, text, "en", f"s{i % 3}", 1, "?"))
    return rows + [(900, None, None, None, 1, "?"), (901, "", "en", "s0", 1, None), (902, "one", "xx", "s1", 1, None), (903, "tail " * 60_000, "en", "s0", 1, None)]


def base(text):
    data = (text or "").encode()
    words = data.split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_rules(table):
    rows = corpus() + [(950, SENTENCE + "\n" + SENTENCE + "\né é", "en", "s", 1, None), (951, SENTENCE, "en", "s", 1, None), (951, SENTENCE, "en", "s", 1, None)]
    docs = table(rows, SCHEMA)
    got = rules.quality_rules(docs).collect()
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        n = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert r.kept <= (not r.base_failed)
    kept = {r.doc_id for r in got if r.kept}
    assert {i for i in range(120) if i % 6} <= kept and not kept & {i for i in range(120) if i % 6 == 0} and len(got) == len(rows)
    passing = rules.keep_passing(docs)
    assert passing.columns == docs.columns and {r.doc_id for r in passing.collect()} == kept
    assert rules.quality_rules(docs.limit(0)).count() == 0


def test_distance_by_hand(table):
    import numpy as np

    refs = rules.language_references(table([(i, t, "en", "s", 1, None) for i, t in enumerate([(SENTENCE + " w%d " % k) * 1 + " ".join("q%d" % j for j in range(120)) for k in range(3)])], SCHEMA))
    ref = refs.filter("ref_lang = 'en'").first()
    text = "Some other words of a text, 12 times the size. " + " ".join("v%d" % j for j in range(100))
    row = rules.quality_rules(table([(1, text, "en", "s", 1, None)], SCHEMA), references=refs).first()
    counts = np.array(rules._kernel()([text.encode()])[5].to_pylist()[0], float)
    p, q = counts / counts.sum(), np.array(ref.ref_chars)
    kl = lambda a, m: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    assert row.char_distance == pytest.approx(np.sqrt((kl(p, (p + q) / 2) + kl(q, (p + q) / 2)) / 2))


def test_word_limit_rejects_junk_and_other_languages(table):
    draw = random.Random(8)
    other = [draw.choice("bcdfg") + draw.choice("aeiou") + "%s%d" % (draw.choice("lmnrt"), 0) for _ in range(5)] + ["stone", "river", "paper", "window", "garden", "winter"]
    other = [w.replace("0", "a") for w in other]

    def text(lang, n):
        common = rules.COMMON_WORDS[lang].split()
        return " ".join(draw.choice(common) if draw.random() < 0.3 else draw.choice(other) + draw.choice("abcdefgh") for _ in range(n))

    rows = [(i, text(lang, draw.choice([110, 180, 400, 900])), lang, "s", 1, None) for i, lang in enumerate(["en", "fr", "de", "es"] * 100)]
    clean = {r[0] for r in rows}
    long = [draw.choice(other) + draw.choice("abcdefgh") for _ in range(300)]
    rows += [(1000, " ".join(long), "en", "s", 1, None), (1001, " ".join(long[:120]), "de", "s", 1, None)]
    rows += [(1100 + k, text(a, n), b, "s", 1, None) for k, (a, b, n) in enumerate([("de", "en", 300), ("en", "fr", 120), ("fr", "de", 900), ("en", "es", 400)])]
    got = {r.doc_id: r for r in rules.quality_rules(table(rows, SCHEMA)).collect()}
    assert not any(r.base_failed for r in got.values()) and all(r.char_distance < rules.MAX_CHAR_DISTANCE for r in got.values())
    assert {i for i in got if got[i].kept} == clean


def test_site_quality(table, spark):
    docs = table(corpus(), SCHEMA)
    labels = table([(i, int(i % 6 > 0), None) for i in range(0, 60)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in sitequality.score_quality(docs, labels).collect()}
    held = [i for i in range(60, 120)]
    assert sum(got[i].kept == (i % 6 > 0) for i in held) >= 0.95 * len(held)
    assert len(got) == 124 and all(0 <= r.score <= 1 for r in got.values())
    good = sitequality.keep_good(docs, labels)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, r in got.items() if r.kept}
    assert sitequality.score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in sitequality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_sparse_paths_shrink(spark):
    """Posteriors by hand: a path of one document follows its site, a large one its own mean."""
    rows = [("a", "big", 0.1)] * 200 + [("a", "one", 0.9)] + [("b", "big", 0.9)] * 200
    scored = spark.createDataFrame(rows, "site string, path string, p double")
    post = {(r[0], r[1]): r for r in sitequality.group_posteriors(scored).collect()}
    assert post["a", "big"].site_post < 0.2 < 0.8 < post["b", "big"].site_post
    assert post["a", "big"].world == pytest.approx((200 * 0.1 + 0.9 + 200 * 0.9) / 401)


def test_toxicity(table):
    draw = random.Random(9)
    words = "river stone light paper window garden morning winter forest valley".split()
    rows, labels = [], []
    for i in range(600):
        text = [draw.choice(words) for _ in range(40)]
        toxic = int(i % 4 == 0)
        if toxic:
            text[draw.randrange(40)] = "vilewordx"
        rows.append((i, " ".join(text), 0.5, "s"))
        labels.append((i, 1, toxic))
    rows += [(900, None, 0.0, "s"), (901, "", 0.0, "s"), (902, "vilewordx river " * 20_000, 0.0, "s"), (None, "river", 0.0, None), (5, rows[5][1], 0.1, "s")]
    docs = table(rows, "doc_id long, text string, score double, source string")
    known = table(labels + [(7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 100 and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert next(r for r in got if r.doc_id == 902).predicted == 1
    assert toxicity.toxicity(docs.limit(0), known.limit(0)).count() == 0
    # labels of held-out rows have no say
    flipped = known.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted((r.doc_id or -1, r.score) for r in toxicity.toxicity(docs, flipped).collect()) == sorted((r.doc_id or -1, r.score) for r in got)
