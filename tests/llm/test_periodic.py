"""Periodic runs against a brute-force version."""

import hashlib
import random
import zlib

import pytest

from panelwright.llm import periodic, queries

SCHEMA = "doc_id long, text string, start string, runs int, row string"


def brute(words):
    """(start, length, period) of all runs, by definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, count):
    draw = random.Random(seed)
    for _ in range(count):
        alphabet = ["a", "b", "ä", "dd", "e"][: draw.choice([1, 2, 2, 3, 5])]
        words = []
        for _ in range(draw.randrange(0, 7)):
            words += [draw.choice(alphabet) for _ in range(draw.randrange(1, 16))] * draw.randrange(1, 9)
            words += [draw.choice("xyzuvw") for _ in range(draw.randrange(0, 4))]
        yield draw.choice([" ", "\n", " \t "]).join(words)


ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (None, "a a a a a a a"), (None, "b b"), (904, "a " * 5), (904, "a " * 5), (905, "a\x0ba\x0ca\ra\ta\na"), (906, "\xa0 " * 8)]


@pytest.mark.parametrize("long_words,tile", [(16_384, 16_384), (40, 16), (10, 64)])
def test_against_brute_force(table, long_words, tile):
    rows = list(enumerate(texts(long_words, 150))) + ODD + [(5000, "tail " * 9000 + "the end of it " * 700)]
    docs = table([(i, t, "x", 1, None) for i, t in rows], SCHEMA)
    got = periodic.collapse(docs, long_words=long_words, tile=tile).collect()
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in got), key=repr)
    want = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = [(0, 9000, 1), (9000, 2800, 4)] if i == 5000 else brute(words)
        want.append((i is None, i or 0, len(words), runs, kept(words, runs)))
    assert found == sorted(want, key=repr)
    assert sum(len(w[3]) for w in want) > 100
    assert periodic.collapse(docs.limit(0)).count() == 0


def test_report_of_the_query(table):
    rows = list(enumerate(texts(7, 120))) + ODD
    docs = table([(i, t, "x", 1, None) for i, t in rows], SCHEMA)
    got = periodic.report(periodic.collapse(docs, edit=queries.repeated_tail, digest=True, long_words=60, tile=32)).collect()
    want = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute(words)
        first = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept(words, runs))]
        want.append((i, len(runs), *first, 1000 * first[1] // first[2] if runs else None, *digest, n))
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words")
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted(want, key=repr)


def test_constant_document_is_linear():
    words = [b"x"] * 30_000
    assert periodic.intervals(periodic.codes_of(words), 0, 30_000, 0, 30_000, 0, 20) == [(1, 0, 29_999)]


def test_stitch(frame):
    cut = frame([(1, 2, 0, 9), (1, 2, 9, 12), (1, 2, 14, 20), (1, 3, 5, 30), (2, 2, 8, 16), (2, 2, 30, 35)], "row long, period long, low long, high long")
    assert sorted(tuple(r) for r in periodic.stitch(cut).collect()) == [(1, 0, 14, 2), (1, 5, 28, 3), (1, 14, 8, 2), (2, 8, 10, 2)]
