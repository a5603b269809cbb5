"""The toxicity model's counts, ratios and weights, recomputed plainly."""

import math
import random

import numpy as np

from panelwright.llm import toxicity
from panelwright.llm.common import fit_logistic


def rows():
    draw = random.Random(3)
    words = "river stone light paper Window garden".split()
    out = []
    for i in range(90):
        text = [draw.choice(words) for _ in range(8)] + (["vileword"] if i % 3 == 0 else [])
        out.append((i, "  ".join(text), int(i % 3 == 0)))
    return out


def grams(text):
    """Bucket of every n-gram, one at a time."""
    data = (" " + " ".join(text.lower().split()) + " ").encode()
    mask = (1 << 64) - 1
    found = set()
    for n in toxicity.NGRAMS:
        for at in range(len(data) - n + 1):
            key = 0
            for c in data[at : at + n]:
                key = (key * 0x9E3779B97F4A7C15 + c) & mask
            mixed = ((key ^ (key >> 29)) * (0xBF58476D1CE4E5B9 + 2 * n)) & mask
            found.add(mixed >> (64 - 18))
    return found


def test_counts_ratios_and_weights(table):
    data = rows()
    docs = table([(i, t) for i, t, _ in data] + [(5, data[5][1])], "doc_id long, text string")
    labels = table([(i, y) for i, _, y in data] + [(400, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = [(grams(t), y) for _, t, y in data]
    n1 = sum(y for _, y in held)
    n0 = len(held) - n1
    want = {}
    for g in set().union(*[h for h, _ in held]):
        c1 = sum(y for h, y in held if g in h)
        c0 = sum(1 - y for h, y in held if g in h)
        a, b, both = (c1 + 1) / (n1 + 2), (c0 + 1) / (n0 + 2), (c0 + c1 + 2) / (n0 + n1 + 4)
        z = (a - b) / math.sqrt(both * (1 - both) * (1 / (n1 + 2) + 1 / (n0 + 2)))
        if abs(z) >= toxicity.MIN_Z and c0 + c1 >= toxicity.MIN_COUNT and abs(math.log(a / b)) >= toxicity.MIN_RATIO:
            want[g] = math.log(a / b)
    assert sorted(want) == model["chosen"].tolist() and len(want) > 5
    x = np.array([[want[g] if g in h else 0.0 for g in sorted(want)] for h, _ in held])
    y = np.array([y for _, y in held], float)
    dense = fit_logistic(x, y, toxicity.RIDGE, rounds=60)
    np.testing.assert_allclose(model["weights"], dense[:-1] * [want[g] for g in sorted(want)], atol=1e-4)
    assert abs(model["intercept"] - dense[-1]) < 1e-3


def test_sparse_fit_is_the_dense_fit():
    draw = np.random.default_rng(1)
    found = [np.flatnonzero(draw.random(30) < 0.2) for _ in range(400)]
    values = draw.standard_normal(30)
    y = (np.array([values[f].sum() for f in found]) + draw.standard_normal(400) > 0.3).astype(float)
    dense = np.zeros((400, 30))
    for i, f in enumerate(found):
        dense[i, f] = values[f]
    rows = toxicity.Sparse(np.concatenate(found).astype(np.int32), np.r_[0, np.cumsum([len(f) for f in found])], values, block=7)
    np.testing.assert_allclose(rows.times(np.arange(30.0)), dense @ np.arange(30.0), atol=1e-9)
    np.testing.assert_allclose(rows.turned(y), dense.T @ y, atol=1e-9)
    np.testing.assert_allclose(toxicity.fit_sparse(rows, y, 1.0), fit_logistic(dense, y, 1.0, 60), atol=1e-4)
    alone = toxicity.fit_sparse(toxicity.Sparse(np.zeros(3, np.int32), np.arange(4), np.ones(1)), np.zeros(3), 1.0)
    assert alone.tolist() == [0.0, math.log(1 / 4)]


def test_the_sample_is_bounded(table):
    docs = table([(1, f"text {i}") for i in range(300)] + [(2, "same")] * 200 + [(3, "other")], "doc_id long, text string")
    labels = table([(1, 1), (1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    picked = toxicity.labelled(docs, labels, "text", "doc_id", "toxic", 40).collect()
    assert len(picked) == 40
    whole = toxicity.labelled(docs, labels, "text", "doc_id", "toxic", 1000).collect()
    assert len(whole) == 302 and sum(r["__id"] == 2 for r in whole) == 1
