"""The positional index against a brute-force version."""

import hashlib
import random
import re

import pytest

from panelwright.llm import phrases

DOCS = "doc_id long, text string, n_words string, spans int, shard string, doc int"
ITEMS = "item_id long, text string, terms string, items int"
FOLD = str.maketrans(phrases.UPPER, phrases.LOWER)


def words_of(text):
    return re.findall(phrases.PATTERN, (text or "").translate(FOLD))


def brute(docs, items, window, near):
    windows = [(i, w[s : s + window]) for i, t in items for w in [words_of(t)] if w for s in range(max(1, len(w) - window + 1))]
    out = []
    for doc_id, text in docs:
        w = words_of(text)
        hit, found, close = set(), set(), set()
        for item, g in windows:
            for s in range(len(w) - len(g) + 1):
                if w[s : s + len(g)] == g:
                    hit.update(range(s, s + len(g)))
                    found.add(item)
            if any(set(g) <= set(w[s : s + near]) for s in range(len(w))):
                close.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit), len(close - {None})))
    return sorted(out, key=repr)


def corpus(seed):
    draw = random.Random(seed)
    common = "the of and to in a".split()
    rare = [f"w{i}é" for i in range(60)]
    pick = lambda: draw.choice(common) if draw.random() < 0.6 else draw.choice(rare)
    items = [(i, " ".join(pick() for _ in range(draw.choice([1, 2, 3, 5, 8, 14, 25])))) for i in range(25)]
    items += [(3, "Second, row; of 3!"), (100, items[7][1]), (None, items[20][1]), (101, None), (102, " .,; "), (103, "the"), (11, "0 1 2 3 4 5 6 7 8 9 10 11")]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(draw.randrange(1, 7)):
            parts += [pick() for _ in range(draw.randrange(0, 12))]
            if draw.random() < 0.4:
                taken = words_of(draw.choice(items)[1])
                if draw.random() < 0.4:
                    draw.shuffle(taken)
                parts += taken
        docs.append((i, draw.choice([" ", "--", ", "]).join(parts)))
    docs += [(500, None), (501, ""), (502, "..."), (None, items[5][1].upper()), (None, items[5][1]), (503, " ".join(["the of and"] * 4000) + " " + items[6][1]), (0, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("seed,shard_words,block,window,near", [(1, 2_000_000, 50_000, 10, 20), (2, 60, 9, 4, 7), (3, 200, 60, 6, 3)])
def test_against_brute_force(table, seed, shard_words, block, window, near):
    docs, items = corpus(seed)
    shards = phrases.index(table([(i, t, "x", 1, "y", 2) for i, t in docs], DOCS), shard_words=shard_words)
    windows = phrases.windows_of(table([(i, t, "x", 1) for i, t in items], ITEMS), window=window)
    rows = phrases.report(phrases.search(shards, windows, near=near, block=block)).collect()
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")) for r in rows), key=repr)
    want = brute(docs, items, window, near)
    assert got == want
    assert sum(r[2] > 0 for r in want) > 20 and sum(r[6] > r[3] for r in want) > 3


def test_spans_and_empty_tables(table):
    docs = table([(1, "x a b c d y a b", "", 1, "", 1), (2, "c a b c d", "", 1, "", 1), (3, "q", "", 1, "", 1)], DOCS)
    items = table([(7, "a b", "", 1), (8, "B C D", "", 1)], ITEMS)
    shards = phrases.index(docs)
    found = {r.doc_id: r for r in phrases.search(shards, phrases.windows_of(items)).collect()}
    assert [tuple(s) for s in found[1].spans] == [(1, 5), (6, 8)] and found[1]["items"] == [7, 8]
    assert [tuple(s) for s in found[2].spans] == [(1, 5)] and found[3].spans == [] == found[3]["items"]
    none = phrases.report(phrases.search(shards, phrases.windows_of(items.limit(0)))).collect()
    assert len(none) == 3 and not any(r.contaminated or r.n_items or r.n_near_items for r in none)
    assert phrases.search(phrases.index(docs.limit(0)), phrases.windows_of(items)).count() == 0


def test_index_holds_every_token(table):
    docs = [(i, f"w{i % 7} the w{i % 3}") for i in range(50)]
    shards = phrases.index(table([(i, t, "", 1, "", 1) for i, t in docs], DOCS), shard_words=40).collect()
    assert len(shards) > 2
    for s in shards:
        places = list(memoryview(s.places).cast("i"))
        at = {}
        for term, low, high in zip(s.terms, [0, *s.ends], s.ends):
            at.update(dict.fromkeys(places[low:high], term.decode()))
        first = 0
        for doc_id, size in zip(s.doc_ids, s.sizes):
            assert " ".join(at[first + k] for k in range(size)) == docs[doc_id][1]
            first += size + 1


def test_shards_are_written_and_read_one_at_a_time(spark):
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"word{i} and word{i % 7}") for i in range(60)], "doc_id long, text string").coalesce(1)
    shards = phrases.index(docs, shard_words=12)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in shards.inputFiles()]
    rows = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert len(rows) == shards.count() == 15 and set(rows) == {1}
