import random

import pytest

from panelwright.llm import neardup


def brute(rows, words, percent):
    sets, label = {}, {}
    for i, text in rows:
        label[i] = i
        parts = (text or "").encode().lower().split()
        size = min(words, len(parts))
        sets[i] = {tuple(parts[k : k + size]) for k in range(len(parts) - size + 1)} if parts else set()
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i], label[i] == i) for i in label}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_against_all_pairs(table, words, percent):
    draw = random.Random(5)
    base = ["w%d" % draw.randrange(10_000) for _ in range(160)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        copy = list(base)
        for _ in range(draw.randrange(0, 7)):
            copy[draw.randrange(160)] = "x%d" % draw.randrange(10_000)
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join("z%d" % draw.randrange(500) for _ in range(draw.randrange(1, 40)))) for i in range(40)]
    rows += [(200, ""), (201, None), (202, "one"), (203, "ONE"), (204, " \t\n"), (205, "a b"), (206, "A  b"), (207, "long " * 30_000)]
    docs = table([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, words=words, percent=percent).collect()}
    assert got == brute(rows, words, percent)


def test_odd_rows(table):
    schema = "doc_id long, text string, lang string"
    docs = table([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", None), (2, "a b c d e f", "y"), (3, None, "y")], schema)
    rows = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def crowd(n, least, most):
    """Copies of one template, most of them just too far from each other."""
    draw = random.Random(11)
    base = ["w%d" % i for i in range(160)]
    rows = []
    for i in range(n):
        copy = list(base)
        for at in draw.sample(range(160), draw.randrange(least, most + 1)):
            copy[at] = "x%d" % draw.randrange(10_000)
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [neardup.BLOCK if hasattr(neardup, "BLOCK") else 0, 40])
def test_links_in_a_crowded_bucket(table, monkeypatch, block):
    if block:
        monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
    rows = crowd(500, 3, 4)
    docs = table(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    want = brute(rows, 3, 85)
    assert 20 < len({x[1] for x in want.values()}) < 480  # neither one group nor all apart
    assert got == want


def test_pairs_that_miss_the_threshold_become_no_rows(table, monkeypatch):
    seen, check = [], neardup.confirmed

    def counted(pairs, sets, percent):
        seen.append(pairs.count())
        return check(pairs, sets, percent)

    monkeypatch.setattr(neardup, "confirmed", counted)
    rows = crowd(400, 5, 6)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 3, 85)
    assert len({x[1] for x in got.values()}) > 300  # near, and nearly all apart
    assert sum(seen) <= neardup.TREES * 2 * len(rows)  # of 79,800 pairs


def test_shared_ids_with_different_texts(table):
    one, two = crowd(2, 1, 1)
    far = " ".join("y%d" % i for i in range(90))
    rows = [(1, one[1]), (1, far), (2, two[1]), (3, far + " z")]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(table(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}
