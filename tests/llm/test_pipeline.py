"""The pipeline's stages: clashing names, repeated ids, odd rows, and the whole chain."""

import random

import pytest

import corpus_pipeline
from panelwright.llm import linedup, neardup, rules, sitequality

NAMES = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["d", "t", "evidence", "ref_lang", "ref_chars", "__lines", "__left", "__features", "__n_words", "__spans", "row", "key", "own", "p", "site", "path", "score", "__kept", "at", "x"]


def texts(count, seed=5):
    draw = random.Random(seed)
    words = "the of and to in a is that for was house tree river stone light paper window garden morning winter".split()
    return [" ".join(draw.choice(words) + ("." if draw.random() < 0.1 else "") for _ in range(80)) for _ in range(count)]


@pytest.fixture
def crowded(table):
    """Ordinary documents with columns whose names the stages use inside."""
    rows = [(i, t, "en", f"s{i % 3}", len(t), *[f"{name} {i}" for name in CLASHES]) for i, t in enumerate(texts(40))]
    return table(rows, NAMES + ", " + ", ".join(f"`{name}` string" for name in CLASHES))


def untouched(kept, docs):
    assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))


def test_clashing_names_stay(crowded, table):
    labels = table([(i, 1, 0) for i in range(0, 40, 2)] + [(999, 0, 0)], "doc_id long, quality int, toxic int")
    untouched(rules.keep_passing(crowded), crowded)
    untouched(sitequality.keep_good(crowded, labels), crowded)
    untouched(linedup.keep_first_runs(crowded), crowded)
    untouched(neardup.keep_one(crowded), crowded)
    with pytest.raises(ValueError, match="repeat a name"):
        linedup.dedup(crowded)


def test_repeated_ids_keep_their_texts(table):
    a, b, c = texts(3)
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (7, b, "en", "s", 1), (8, a, "en", "s", 1), (9, c, "en", "s", 1), (9, c, "en", "s", 1), (None, a, "en", "s", 1)]
    kept = neardup.keep_one(table(rows, NAMES)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, a), (5, a), (5, b), (9, c)])


def test_the_whole_chain(spark, table, tmp_path):
    body = texts(60)
    run = "\n".join(f"a line of the long passage that many documents share, number {i}" for i in range(8))
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(body)]
    rows += [(100 + i, body[i] + " And one more sentence.", "en", "s1", 0) for i in range(5)]  # near copies
    rows += [(200 + i, body[10 + i] + "\n" + run, "en", "s2", 0) for i in range(3)]  # near copies once the passage is gone
    rows += [(300, None, "en", "s0", None), (301, "", "en", "s0", 0), (302, "too short", "xx", None, 9), (303, "buy now " * 3000, "en", "s0", 0), (None, body[50], None, None, 0)]
    rows += [(304, " ".join(texts(400, 9)), "en", "s0", 0)]  # a very long one
    table(rows, NAMES).write.parquet(str(tmp_path / "documents.parquet"))
    table([(i, 1, 0) for i in range(40)] + [(303, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert set(range(10)) <= ids and not ids & {300, 301, 302, 303} and {None, 304} <= ids
    assert not ids & set(range(100, 105)) and len([i for i in ids if i is not None and i < 60]) >= 58
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).limit(0).write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
