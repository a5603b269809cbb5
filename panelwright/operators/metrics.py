"""Prediction-quality metrics per date and overall."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.safe import clip, finite, is_finite
from .groups import GroupProfile, average_rank, average_ranks, by_whole_groups, profile_groups


# ---- moments that survive any magnitude -------------------------------------------------------------------------
#: Values are counted in magnitude classes, 512 binary digits wide; inside a class squares stay finite and nonzero.
CLASS_BITS = 512


def _magnitude(value: Column) -> Column:
    """-2 .. 2: the class of a value's binary exponent; zeros join the lowest."""
    return F.when(value != 0, F.floor((F.log2(F.abs(value)) + CLASS_BITS // 2) / CLASS_BITS)).otherwise(-2).cast("int")


def _shifted(value: Column, classes: Column) -> Column:
    """The value times 2^(512 * classes), exactly; in two steps, since one factor alone might overflow."""
    step = F.pow(F.lit(2.0), classes * (CLASS_BITS // 2))
    return value * step * step


def pair_moments(frame: DataFrame, keys: Sequence[str], x: str, y: str, extra: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Per group ``n, sx, sy, sxy, x_class, y_class`` and both ranges, over rows where neither side is NULL.

    Rows are first added up by group and magnitude class, each class in its own power of two, so tiny squares
    do not vanish and huge ones do not overflow; then the few classes of a group are brought to the largest one and
    merged as central moments.  Both steps combine before the exchange: no row crosses the network.  ``sx`` is
    the sum of squares about the mean in units of 4^(512 * x_class).  ``extra`` adds aggregates
    (how to merge them: sum, min or max; the aggregate).
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = frame.withColumns({"_x": F.when(both, F.col(x)), "_y": F.when(both, F.col(y))})
    rows = rows.withColumns({"_cx": F.when(both, _magnitude(F.col("_x"))), "_cy": F.when(both, _magnitude(F.col("_y")))})
    rows = rows.withColumns({"_sx": _shifted(F.col("_x"), -F.col("_cx")), "_sy": _shifted(F.col("_y"), -F.col("_cy"))})
    n = F.count("_x")
    merged = {"x_min": ("min", F.min("_x")), "x_max": ("max", F.max("_x")), "y_min": ("min", F.min("_y")), "y_max": ("max", F.max("_y"))} | (extra or {})
    classes = rows.groupBy(*keys, "_cx", "_cy").agg(
        n.alias("n"), F.avg("_sx").alias("mx"), F.avg("_sy").alias("my"), (F.var_pop("_sx") * n).alias("sx"), (F.var_pop("_sy") * n).alias("sy"),
        (F.covar_pop("_sx", "_sy") * n).alias("sxy"), *[column.alias(name) for name, (_, column) in merged.items()],
    )
    part = F.when(F.col("n") > 0, F.struct(F.col("_cx").alias("cx"), F.col("_cy").alias("cy"), "n", "mx", "my", "sx", "sy", "sxy"))
    whole = classes.groupBy(*keys).agg(
        F.sort_array(F.collect_list(part)).alias("_parts"), F.max("_cx").alias("x_class"), F.max("_cy").alias("y_class"),
        *[getattr(F, how)(name).alias(name) for name, (how, _) in merged.items()],
    )
    lift = "transform(_parts, p -> struct(p.n AS n, p.mx * {x} AS mx, p.my * {y} AS my, p.sx * {x} * {x} AS sx, p.sy * {y} * {y} AS sy, p.sxy * {x} * {y} AS sxy))".format(
        x=f"pow(2D, {CLASS_BITS} * (p.cx - x_class))", y=f"pow(2D, {CLASS_BITS} * (p.cy - y_class))"
    )
    weight = "a.n * CAST(b.n AS DOUBLE) / (a.n + b.n)"
    merge = (
        "(a, b) -> struct(a.n + b.n AS n, a.mx + (b.mx - a.mx) * b.n / (a.n + b.n) AS mx, a.my + (b.my - a.my) * b.n / (a.n + b.n) AS my, "
        f"a.sx + b.sx + (b.mx - a.mx) * (b.mx - a.mx) * {weight} AS sx, a.sy + b.sy + (b.my - a.my) * (b.my - a.my) * {weight} AS sy, "
        f"a.sxy + b.sxy + (b.mx - a.mx) * (b.my - a.my) * {weight} AS sxy)"
    )
    zero = "struct(0L AS n, 0D AS mx, 0D AS my, 0D AS sx, 0D AS sy, 0D AS sxy)"
    whole = whole.withColumn("_m", F.expr(f"aggregate({lift}, {zero}, {merge})"))
    return whole.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in ("n", "sx", "sy", "sxy")], "x_class", "y_class", *merged)


def moment_correlation() -> Column:
    """Pearson out of :func:`pair_moments`, within -1 and 1; 0 for fewer than two rows or a constant side."""
    spread = F.sqrt("sx") * F.sqrt("sy")
    flat = (F.col("n") < 2) | (F.col("x_min") == F.col("x_max")) | (F.col("y_min") == F.col("y_max"))
    return F.when(flat, 0.0).otherwise(clip(F.when(spread > 0, F.col("sxy") / F.nullif(spread, F.lit(0.0))), F.lit(-1.0), F.lit(1.0)))


def daily_regression_metrics(frame: DataFrame, prediction: str, label: str, keys: Sequence[str] = ("Date",)) -> DataFrame:
    """Per date ``ic, mse, r2, n_rows`` over rows where both sides are finite.

    A constant side or fewer than two rows gives an IC of 0.
    """
    p, y = finite(F.col(prediction).cast("double")), finite(F.col(label).cast("double"))
    pairs = frame.select(*keys, p.alias("p"), y.alias("y"))
    square = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    extra = {"n_rows": ("sum", F.count(F.lit(1))), "residual": ("sum", F.sum(square))}
    stats = pair_moments(pairs, keys, "p", "y", extra)
    total = _shifted(_shifted(F.col("sy"), F.col("y_class")), F.col("y_class"))
    few = F.col("n") < 2
    usable = ~few & is_finite(total) & (total > 0)
    r2 = F.when(usable, 1 - F.col("residual") / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    mse = F.when(F.col("n") > 0, F.col("residual") / F.col("n")).otherwise(0.0)
    return stats.select(*keys, moment_correlation().alias("ic"), mse.alias("mse"), r2.alias("r2"), "n_rows")


def mean_daily_metrics(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Equal-weight means over dates of finite daily values, with date and row counts."""
    return daily.groupBy(*by).agg(
        F.avg(finite(F.col("ic"))).alias("DailyICMean"),
        F.avg(finite(F.col("mse"))).alias("DailyMSEMean"),
        F.avg(finite(F.col("r2"))).alias("DailyR2Mean"),
        F.count(F.lit(1)).alias("NumDates"),
        F.sum("n_rows").alias("NumRows"),
    )


def regression_metrics(
    frame: DataFrame,
    prediction: str = "prediction",
    label: str = "target",
    by: Sequence[str] = (),
    date: str = "Date",
) -> DataFrame:
    """The five summary metrics, overall or per group."""
    daily = daily_regression_metrics(frame, prediction, label, (*by, date))
    return mean_daily_metrics(daily, by)


def _correlations_of_group():
    """Pearson and average-tie Spearman of one group, within -1 and 1; 0 where a side is constant."""

    def pearson(x: np.ndarray, y: np.ndarray) -> float | None:
        # In the power of two of the largest value, so that squares neither overflow nor vanish.
        x, y = (np.ldexp(side, -int(np.frexp(np.abs(side).max())[1])) for side in (x, y))
        x, y = x - x.mean(), y - y.mean()
        spread = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
        return float(np.clip((x * y).sum() / spread, -1.0, 1.0)) if spread > 0 else None

    def correlations(s: np.ndarray, r: np.ndarray) -> list:
        both = ~np.isnan(s) & ~np.isnan(r)
        s, r = s[both], r[both]
        if len(s) < 2 or s.min() == s.max() or r.min() == r.max():
            return [0.0, 0.0]
        return [pearson(s, r), pearson(average_ranks(s), average_ranks(r))]

    return correlations


def daily_predictive_metrics(
    panel: DataFrame,
    score: str = "score",
    outcome: str = "return",
    keys: Sequence[str] = ("model", "Date"),
    profile: GroupProfile | None = None,
    models: Sequence[str] | None = None,
) -> DataFrame:
    """Per model and date ``ic`` (Pearson) and ``rank_ic`` (average-tie Spearman).

    Incomplete pairs are dropped before ranking; degenerate dates give 0.  With *models* the panel is wide: each of
    these columns holds the scores of a model, and *keys* and *profile* are those of the wide panel.
    """
    keys = list(keys)
    outputs = [(name, T.DoubleType()) for name in ("ic", "rank_ic")]
    if models is not None:
        profile = profile or profile_groups(panel, keys)
        if profile.fits_window:
            rows = panel.select(*keys, *[finite(F.col(name).cast("double")).alias(name) for name in (*models, outcome)])
            return by_whole_groups(rows, keys, [outcome], _correlations_of_group(), outputs, each=("model", models))
        panel, keys = panel.unpivot([*keys, outcome], list(models), "model", score), ["model", *keys]
    s, r = finite(F.col(score).cast("double")), finite(F.col(outcome).cast("double"))
    both = s.isNotNull() & r.isNotNull()
    pairs = panel.select(*keys, F.when(both, s).alias("s"), F.when(both, r).alias("r"))
    profile = profile or profile_groups(pairs, keys)
    if profile.fits_window:
        return by_whole_groups(pairs, keys, ["s", "r"], _correlations_of_group(), outputs)
    complete = pairs.filter(F.col("s").isNotNull())
    ranked = average_rank(complete, keys, "s", "s_rank", profile)
    ranked = average_rank(ranked, keys, "r", "r_rank", profile)
    missing = pairs.filter(F.col("s").isNull()).select(
        *keys, "s", "r", F.lit(None).cast("double").alias("s_rank"), F.lit(None).cast("double").alias("r_rank")
    )
    ranked = ranked.select(*missing.columns).unionByName(missing)
    # Ranks are whole halves: their plain sums lose nothing and merge like any sum.
    a, b = F.col("s_rank"), F.col("r_rank")
    sums = {"a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}
    stats = pair_moments(ranked, keys, "s", "r", {f"rank_{name}": ("sum", F.sum(term)) for name, term in sums.items()})
    n, a, b, aa, bb, ab = (F.col(name) for name in ("n", "rank_a", "rank_b", "rank_aa", "rank_bb", "rank_ab"))
    spread = F.sqrt(n * aa - a * a) * F.sqrt(n * bb - b * b)
    flat = (n < 2) | (F.col("x_min") == F.col("x_max")) | (F.col("y_min") == F.col("y_max"))
    rank_ic = F.when(flat, 0.0).otherwise(F.when(spread > 0, (n * ab - a * b) / F.nullif(spread, F.lit(0.0))))
    return stats.select(*keys, moment_correlation().alias("ic"), rank_ic.alias("rank_ic"))
