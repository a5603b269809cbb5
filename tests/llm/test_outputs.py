"""Packing, licences, id files, one-bit search, line runs."""

import itertools
import random
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from panelwright.llm import idfiles, licenses, linedup, onebit, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_boundaries_are_optimal():
    draw = random.Random(1)
    for _ in range(20):
        lengths = sorted(draw.sample(range(1, 60), draw.randrange(1, 9)))
        counts = np.array([draw.randrange(1, 9) for _ in lengths], float)
        for k in range(1, 5):
            cuts = packing.boundaries(np.array(lengths, float), counts, counts * lengths, k)
            cost = lambda c: sum(n * (min(x for x in c if x >= v) - v) for v, n in zip(lengths, counts))
            best = min(cost([*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], min(m, len(lengths) - 1)))
            assert cuts[-1] == lengths[-1] and len(cuts) <= k and cost(cuts) == best


def test_pack(table):
    draw = random.Random(2)
    rows = [(i, " ".join(["w"] * draw.randrange(0, 300)), 1) for i in range(400)] + [(900, None, 1), (901, "", 1), (902, "w " * 20_000, 1), (3, "w", 1), (3, "w", 1), (None, "w w", 1)]
    docs = table(rows, "doc_id long, text string, bucket int")
    got = packing.pack(docs, budget=2000, buckets=4, slice_docs=50).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, len((t or "").split())) for i, t, _ in rows)
    batches = defaultdict(list)
    for r in got:
        batches[r.batch].append(r)
        assert r.n_tokens + r.padding == r.bucket_length and r.padding >= 0
    for b in batches.values():
        assert len(b) == b[0].batch_docs and sorted(r.position for r in b) == list(range(len(b))) and len({r.bucket for r in b}) == 1
        assert len(b) == 1 or len(b) * b[0].bucket_length <= 2000
    assert packing.pack(docs.limit(0)).count() == 0


def test_published_licence_forms(table):
    import textwrap

    isc, bsd, mit = licenses.KNOWN["ISC"], licenses.KNOWN["BSD-2-Clause"], licenses.KNOWN["MIT"]
    wrapped = isc.replace("above copyright notice", "above\ncopyright notice")
    rows = [
        (1, wrapped, "ISC"), (2, "ISC License\n\nCopyright (c) 2020, A. Holder <a@b.c>\n\n" + wrapped, "ISC"),
        (3, "MIT License\n\nCopyright (c) 2020 A\n\n" + mit, "MIT"), (4, "The MIT License (MIT)\n\nCopyright The Authors\n\n" + textwrap.fill(mit, 60), "MIT"),
        (5, "BSD 2-Clause License\n\nCopyright 2020 A\nAll rights reserved.\n\n" + bsd.replace("1. ", "\n* ").replace("2. ", "\n* "), "BSD-2-Clause"),
        (6, "BSD 3-Clause License\n\n" + licenses.MORE["BSD-3-Clause"] if hasattr(licenses, "MORE") else "", "BSD-3-Clause"),
        (7, isc.replace("copyright notice and ", ""), None), (8, "GNU License\n\n" + mit, None), (9, "copyright notice", None),
    ]
    rows += [(100 + w, "\n".join(textwrap.wrap(text, w)), name) for w in range(40, 100, 4) for name, text in (("ISC", isc), ("MIT", mit), ("BSD-2-Clause", bsd))][::4]
    got = {r.doc_id: r.license for r in licenses.scan(table([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, lang string")).collect()}
    assert got == {i: name for i, _, name in rows}


def test_licenses(table):
    mit = licenses.KNOWN["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper(), "x"), (2, mit.replace("sublicense", "sublicence").replace('"', "“") + "\nAll rights reserved.", "x"),
        (3, "Before. " + mit, "x"), (4, None, "x"), (5, "", "x"), (6, "Copyright 1999 A", "x"), (7, "licensed under the APACHE license version 2.0", "x"), (7, "licensed under the APACHE license version 2.0", "x"),
        (8, "word " * 50_000, "x"), (None, mit, "x"),
    ]
    docs = table(rows, "doc_id long, text string, digest string")
    got = sorted((r.doc_id or -1, r.license) for r in licenses.scan(docs).collect())
    assert got == [(-1, "MIT"), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (7, "Apache-2.0-notice"), (7, "Apache-2.0-notice"), (8, None)]
    own = docs.sparkSession.createDataFrame([("own", "word " * 50_000)], "license string, text string")
    assert [r.doc_id for r in licenses.scan(docs, own).filter("license = 'own'").collect()] == [8]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_id_files(table, spark):
    texts = ["The thing  is.\nNext", "", None, " lead and trail ", "a\n b   c", "<|endoftext|> x", "été 漢字 it's 12 ", "w" * 3000, "long text " * 20_000, "\t \t"]
    rows = [(100 - i, t, "x") for i, t in enumerate(texts)] + [(i, "the word of %d" % i, "y") for i in range(60)] + [(5, "again", None), (None, "none", None)]
    docs = table(rows, "doc_id long, text string, start string")
    folder = tempfile.mkdtemp(prefix="ids-")
    idfiles.write(docs, folder, PATH, shard_docs=7)
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    got = sorted(idfiles.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r.start == at and r.ids in want[r.doc_id]
        at += len(r.ids)
    digest = idfiles.read(spark, folder, digest=True).collect()
    assert all(any(r.ids_crc32 == zlib.crc32(np.array(x, "<u4").tobytes()) and r.n_tokens == len(x) for x in want[r.doc_id]) for r in digest)
    assert idfiles.read_documents(spark, folder, [100, 30]) == {100: want[100][0], 30: want[30][0]}
    assert idfiles.round_trip(docs.limit(0), PATH).count() == 0


def test_nearest(table):
    draw = np.random.default_rng(4)
    x = draw.standard_normal((400, 24)).round(2)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist(), 1) for i in range(30)]
    odd = [(2000, None, 1), (2020, [], 1), (2040, [0.0] * 24, 1), (2060, [1.0] * 23 + [float("nan")], 1), (2080, [1.0] * 23 + [None], 1), (2100, [1.0] * 5, 1), (None, x[0].tolist(), 1), (20, x[20].tolist(), 2)]
    vectors = table(rows + odd, "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in sorted(onebit.search(vectors, block=64, query_block=8).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    usable = rows + [odd[-1]]
    ids, m = np.array([r[0] for r in usable]), np.array([r[1] for r in usable])
    hits = total = 0
    assert set(got) == {i for i in ids if i % 20 == 0}
    for q, found in got.items():
        score = (m * m[list(ids).index(q)]).sum(1)
        best = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:20]
        hits += len({(int(ids[j]), float(score[j])) for j in best} & {(i, s) for _, i, s in found})
        total += len({(int(ids[j]), float(score[j])) for j in best})
        assert [r for r, _, _ in found] == list(range(1, 21)) and [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
    assert hits >= 0.97 * total
    assert onebit.search(vectors.limit(0)).count() == 0
    assert onebit.search(table(rows[:4], "vec_id long, embedding array<double>, score int")).count() == 3


def brute_runs(docs, least):
    """Positions covered by a run of enough words that also starts earlier in the corpus."""
    lines = [(d, i, x) for d, t in docs for i, x in enumerate(t.split("\n"))]
    gone = set()
    for a in range(len(lines)):
        for b in range(a):
            n = words = 0
            while a + n < len(lines) and lines[a + n][0] == lines[a][0] and lines[b + n][0] == lines[b][0] and lines[a + n][2] == lines[b + n][2]:
                words += len(lines[a + n][2].split())
                n += 1
            if words >= least:
                gone.update((lines[a][0], lines[a + k][1]) for k in range(n))
    return gone


def test_line_runs(table):
    draw = random.Random(7)
    for trial in range(3):
        pool = [" ".join("w%d" % draw.randrange(50) for _ in range(draw.randrange(0, 6))) for _ in range(6 + trial)]
        docs = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(1, 14)))) for i in range(14)]
        rows = [(i, t, 0) for i, t in docs] + [(50, None, 0), (60, "", 0), (61, "", 0)]
        got = {r.doc_id: r for r in linedup.dedup(table(rows, "doc_id long, text string, last int"), min_words=8).collect()}
        gone = brute_runs(docs, 8)
        for i, t in docs:
            assert got[i]["__left"] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
            assert got[i]["__deleted"] == sum(d == i for d, _ in gone)
        assert got[50]["__left"] is None and got[60]["__left"] == ""


def test_line_runs_odd_rows(table):
    run = "\n".join("line %d of the passage" % i for i in range(30))
    rows = [(1, run, "a"), (1, run, "b"), (2, "head\n" + run + "\ntail", "c"), (3, run, "d"), (None, "x", None)]
    docs = table(rows, "doc_id long, text string, d string")
    kept = linedup.keep_first_runs(docs)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "x"), (1, run), (1, run), (2, "head\ntail")]
    assert linedup.deletions(docs.limit(0)).count() == 0
