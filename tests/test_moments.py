"""Correlations of any magnitude, from aggregates that combine before the exchange."""

import re
from fractions import Fraction
from math import sqrt

import numpy as np
import pytest

from panelwright.operators import metrics as M

SCHEMA = "Date int, p double, y double"


def exact(x, y):
    """Pearson with rational sums."""
    x, y = [Fraction(float(v)) for v in x], [Fraction(float(v)) for v in y]
    n = len(x)
    mx, my = sum(x) / n, sum(y) / n
    sxy = sum((a - mx) * (b - my) for a, b in zip(x, y))
    sx, sy = (sum((a - m) ** 2 for a in v) for v, m in ((x, mx), (y, my)))
    ratio = sxy * sxy / (sx * sy)
    return (1 if sxy > 0 else -1) * sqrt(ratio)


@pytest.mark.parametrize("x_scale,y_scale", [(1e-200, 1.0), (1e-310, 1e-200), (1e200, 1e-250), (1e300, 1e300), (2.0**-256, 2.0**256), (1.0, 1.0)])
def test_any_magnitude(spark, x_scale, y_scale):
    draw = np.random.default_rng(1)
    x, y = draw.standard_normal(60), draw.standard_normal(60)
    y = (0.4 * x + y) * y_scale
    x = x * x_scale
    x[:3] = 0.0
    rows = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)] + [(1, None, 1.0), (1, float("nan"), 2.0), (2, 5.0, 1.0)], SCHEMA).repartition(5)
    got = {r.Date: r for r in M.daily_regression_metrics(rows, "p", "y").collect()}
    assert got[1].ic == pytest.approx(exact(x, y), rel=1e-7 if x_scale < 1e-300 else 1e-12)
    assert (got[1].n_rows, got[2].n_rows, got[2].ic) == (62, 1, 0.0)
    panel = rows.selectExpr("'m' AS model", "Date", "p AS score", "y AS return")
    assert {r.Date: r.ic for r in M.daily_predictive_metrics(panel).collect()}[1] == pytest.approx(got[1].ic, rel=1e-12)


def test_mixed_magnitudes_and_large_means(spark):
    x = [1e-250, 3e-250, 1.0, 2.0, 1e-5, 7e150, 1e152]
    y = [1.0, 2.0, -4.0, 1e-200, 3.0, 5.0, 9.0]
    close = [1e9 + i * 1e-3 for i in (0, 1, 5, 2, 8)]
    other = [3.0, 1.0, 4.0, 1.0, 5.0]
    rows = [(1, a, b) for a, b in zip(x, y)] + [(2, a, b) for a, b in zip(close, other)] + [(3, 1e-200, 1.0), (3, 1e-200, 2.0)]
    got = {r.Date: r.ic for r in M.daily_regression_metrics(spark.createDataFrame(rows, SCHEMA).repartition(3), "p", "y").collect()}
    assert got[1] == pytest.approx(exact(x, y), rel=1e-12)
    assert got[2] == pytest.approx(exact(close, other), rel=1e-6)
    assert got[3] == 0.0


def test_only_aggregates_are_exchanged(spark):
    rows = spark.range(1000).selectExpr("CAST(id % 5 AS INT) AS Date", "CAST(id AS DOUBLE) AS p", "CAST(id * id % 7 AS DOUBLE) AS y")
    plan = M.daily_regression_metrics(rows, "p", "y")._jdf.queryExecution().executedPlan().toString()
    lines = [re.sub(r"^[\s:+\-*()\d]*", "", line) for line in plan.splitlines()]
    below = [lines[i + 1] for i, line in enumerate(lines) if line.startswith("Exchange")]
    assert below and all("Aggregate" in line and "partial_" in line for line in below)
    assert not any(line.startswith(("Sort ", "Window", "SortAggregate")) for line in lines)
