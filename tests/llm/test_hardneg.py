"""Hard negatives against a brute-force version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, score string, block string"
NAN, INF = float("nan"), float("inf")


def brute(rows, positives=5, negatives=3, low=50, high=95, step=50):
    fit = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    sizes = [len(r[1]) for r in fit]
    size = min(set(sizes), key=lambda n: (-sizes.count(n), n)) if sizes else 0
    one = {}
    for i, v, label, *_ in fit:
        if len(v) == size:
            mine = (label, [math.floor(256 * c) for c in v])
            one[i] = min(one.get(i, mine), mine)
    out = []
    for a, (label, x) in one.items():
        if a % step:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other == label) for i, (other, y) in one.items() if i != a)
        for score, p, _ in [s for s in scored if s[2]][:positives]:
            fits = [(i, -s) for s, i, same in scored if not same and low * -score <= 100 * -s <= high * -score]
            out += [(a, p, k + 1, i, -score, s) for k, (i, s) in enumerate(fits[:negatives])]
    return sorted(out)


def found(frame):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in frame.collect())


@pytest.mark.parametrize("seed,kind", [(1, "gauss"), (2, "ties"), (3, "sparse")])
def test_against_brute_force(table, seed, kind):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((420, 12))
    if kind == "ties":
        x = draw.integers(-1, 2, (420, 12)) / 4
    if kind == "sparse":
        x = np.where(draw.random((420, 12)) < 0.8, 0.0, x)
    rows = [(int(i * 5), v.tolist(), int(draw.integers(0, 4)), "s", "b") for i, v in enumerate(x)]
    rows += [(9000 + i, rows[0][1], 3, "copy", None) for i in range(60)] + [rows[10], rows[10]]
    got = found(hardneg.mine(table(rows, SCHEMA), block=64, group=3))
    assert got == brute(rows) and len(got) > 20


def test_odd_rows(table):
    v = [0.5, -0.25, 0.125]
    rows = [
        (0, v, 1, "a", None), (50, v, 1, "a", None), (100, [0.0, 0.0, 0.0], 1, "a", None), (1, [0.4, -0.25, 0.0], 2, "b", None), (2, [0.2, 0.0, 0.1], 2, "b", None),
        (3, None, 2, "", None), (4, [0.4, None, 0.1], 2, "", None), (5, [0.4, NAN, 0.1], 2, "", None), (6, [0.4, INF, 0.1], 2, "", None), (7, v, None, "", None), (None, v, 2, "", None),
        (8, [], 2, "", None), (9, v + [1.0], 2, "", None), (150, v, 9, "alone", None), (2, [0.3, 0.0, 0.1], 1, "again", None),
    ]
    got = found(hardneg.mine(table(rows, SCHEMA)))
    assert got == brute(rows) and {r[0] for r in got} == {0, 50, 100}
    assert hardneg.mine(table(rows[:0], SCHEMA)).count() == 0
    assert hardneg.mine(table(rows[5:9], SCHEMA)).count() == 0


def test_large_components(table):
    rows = [(0, [30.5, -7.0], 1, "", ""), (1, [9000.0, 3.0], 1, "", ""), (2, [6000.0, 1.0], 2, "", ""), (3, [100_000.25, -50_000.0], 3, "", "")]
    assert found(hardneg.mine(table(rows, SCHEMA))) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        hardneg.mine(table(rows + [(4, [1e7, 0.0], 1, "", "")], SCHEMA)).collect()


def test_walk_stops_by_the_threshold():
    draw = np.random.default_rng(5)
    x = (draw.standard_normal((4096, 2)) * 256).round().astype(np.int32)
    ids, labels = np.arange(4096), np.zeros(4096, np.int64)
    orders = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
    best = hardneg.Best(1, 3)
    a = np.array([[200, -150]])
    scored = hardneg.walk(ids, labels, x, orders, (np.array([-1]), np.array([0]), a), (np.array([0]), np.array([hardneg.LEAST]), np.array([hardneg.MOST])), best, True)
    score = x.astype(np.int64) @ a[0]
    want = np.lexsort((ids, -score))[:3]
    assert best.id.tolist() == want.tolist() and best.score.tolist() == score[want].tolist()
    assert scored < 2000  # the lists were not read to their ends


def test_label_and_anchor_are_free(table):
    rows = [(i, [0.1 * (i % 7), 0.2, -0.1 * (i % 3)], i % 3, "", "") for i in range(40)]
    got = found(hardneg.mine(table(rows, SCHEMA), anchor=F.col("vec_id") % 8 == 0, label=F.col("label") + 1, positives=2, negatives=4))
    assert got == brute(rows, positives=2, negatives=4, step=8)


def test_groups_and_blocks_meet_without_a_join(table, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [(int(i * 5), v.tolist(), int(draw.integers(0, 3)), "s", "b") for i, v in enumerate(draw.standard_normal((600, 6)))]
    plans, first = [], hardneg._first
    monkeypatch.setattr(hardneg, "_first", lambda frame, *rest: plans.append(frame) or first(frame, *rest))
    monkeypatch.setattr(hardneg, "SHARE", 2)
    for band in (1, 3):
        monkeypatch.setattr(hardneg, "TILES", 20 // band)
        monkeypatch.setattr(hardneg, "BAND", band)
        got = found(hardneg.mine(table(rows, SCHEMA), block=30, group=7))
        assert got == brute(rows) and len(got) > 20
    for plan in plans:
        above = plan._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]  # the groups themselves are put together below
        assert "Join" not in above and "MapInArrow" in above
