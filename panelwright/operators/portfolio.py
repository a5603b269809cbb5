"""Equal-notional quantile portfolios."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.safe import finite, is_finite
from .contracts import duplicate_keys, require_columns, require_empty, row_guard
from .groups import GroupProfile, by_whole_groups, profile_groups, with_group_stats, with_position

# Selection modes and cumulative quantiles, in report order.
MODES = ("signed", "long_only")
QUANTILES = (1.0, 0.75, 0.5, 0.25)
TRADING_DAYS = 252.0

def canonical_quantile(quantile: float) -> float:
    for known in QUANTILES:
        if abs(float(quantile) - known) <= 1e-12:
            return known
    raise ValueError(f"quantile must be one of {QUANTILES}, got {quantile!r}")


def canonical_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    return mode


def _eligible(score: Column, mode: str) -> Column:
    usable = (score != 0) if mode == "signed" else (score > 0)
    return F.coalesce(is_finite(score) & usable, F.lit(False))


def _with_known_keys(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    known = F.coalesce(F.col("Code").cast("string"), F.lit("")) != ""
    for key in keys:
        known = known & F.col(key).isNotNull()
    return panel.filter(row_guard(known, "a score row lacks a key"))


def _repeats(keys: Sequence[str]) -> str:
    return f"score rows repeat a key of {[*keys, 'Code']}"


def ranked_panel(
    panel: DataFrame,
    modes: Sequence[str] = MODES,
    keys: Sequence[str] = ("model", "Date"),
    score: str = "score",
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Add per mode the selection order and the eligible count within each group.

    Ineligible rows sort last, strength falls, and Code breaks ties.  Both modes
    share one exchange; all quantiles share the same order.
    """
    keys = list(keys)
    panel = _with_known_keys(panel, keys)
    value = F.col(score).cast("double")
    panel = panel.withColumns({f"_e_{mode}": _eligible(value, mode) for mode in modes})
    profile = profile or profile_groups(panel, keys)
    twice = _repeats(keys)
    if profile.fits_window:
        # The same exchange as the ranking; one more sort inside the group.
        before = F.lag("Code").over(Window.partitionBy(*keys).orderBy("Code"))
        fresh = F.col("_before").isNull() | (F.col("_before") != F.col("Code"))
        panel = panel.withColumn("_before", before).filter(row_guard(fresh, twice)).drop("_before")
    else:
        require_empty(duplicate_keys(panel, [*keys, "Code"]), twice)
    counts = {f"n_{mode}": F.count_if(F.col(f"_e_{mode}")) for mode in modes}
    panel = with_group_stats(panel, keys, counts, profile)
    for mode in modes:
        strength = F.when(F.col(f"_e_{mode}"), -F.abs(value)).otherwise(F.lit(float("inf")))
        order = [strength.alias("_s"), F.col("Code").alias("_c")]
        if profile.fits_window:
            order = [strength, F.col("Code")]
        panel = with_position(panel, keys, order, f"place_{mode}", profile)
    return panel


def _selected(mode: str, quantile: float) -> Column:
    return F.col(f"_e_{mode}") & (F.col(f"place_{mode}") <= F.ceil(F.lit(quantile) * F.col(f"n_{mode}")))


def select_top_quantile(
    panel: DataFrame,
    mode: str,
    quantile: float,
    keys: Sequence[str] = ("Date",),
    score: str = "score",
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Selected rows of each group with their ``position`` (sign of the score, or 1)."""
    mode, quantile = canonical_mode(mode), canonical_quantile(quantile)
    require_columns(panel, (*keys, "Code", score), "score panel")
    ranked = ranked_panel(panel, [mode], keys, score, profile).filter(_selected(mode, quantile))
    position = F.signum(F.col(score).cast("double")) if mode == "signed" else F.lit(1.0)
    return ranked.select(*panel.columns, position.alias("position"))


#: What is counted of the selected rows of a group.
PARTS = ("pnl", "selected", "hits", "moves", "longs", "observed")


def _grid_by_aggregates(
    panel: DataFrame, score: str, outcome: str, modes: Sequence[str], quantiles: Sequence[float], keys: Sequence[str], profile: GroupProfile
) -> DataFrame:
    """``<mode>_<index>_<part>`` of every group, for groups of any size."""
    ranked = ranked_panel(panel, modes, keys, score, profile)
    value, realised = F.col(score).cast("double"), finite(F.col(outcome).cast("double"))
    ranked = ranked.withColumns({"_r": realised, "_sign": F.signum(value)})
    aggregates = []
    for mode in modes:
        position = F.col("_sign") if mode == "signed" else F.lit(1.0)
        gain = position * F.col("_r")
        for index, quantile in enumerate(quantiles):
            chosen, tag = _selected(mode, quantile), f"{mode}_{index}"
            aggregates += [
                F.coalesce(F.sum(F.when(chosen, gain)), F.lit(0.0)).alias(f"{tag}_pnl"),
                F.count_if(chosen).alias(f"{tag}_selected"),
                F.count_if(chosen & (gain > 0)).alias(f"{tag}_hits"),
                F.count_if(chosen & (F.col("_r") != 0)).alias(f"{tag}_moves"),
                F.count_if(chosen & (position > 0)).alias(f"{tag}_longs"),
                F.count_if(chosen & F.col("_r").isNotNull()).alias(f"{tag}_observed"),
            ]
    return ranked.groupBy(*keys).agg(*aggregates)


def _grid_of_group(modes: Sequence[str], quantiles: Sequence[float]) -> Callable[[np.ndarray, np.ndarray], list]:
    """The grid of one group out of scores and returns in the order of Code (missing: NaN)."""

    def grid(score: np.ndarray, realised: np.ndarray) -> list:
        usable = np.flatnonzero(np.isfinite(score) & (score != 0))
        # Stable, so equal strengths stay in the order of Code.
        order = usable[np.argsort(-np.abs(score[usable]), kind="stable")]
        found = []
        for mode in modes:
            rows = order if mode == "signed" else order[score[order] > 0]
            r, sign = realised[rows], np.sign(score[rows])
            seen = ~np.isnan(r)
            gain = np.where(seen, sign * r, 0.0)
            counts = [gain > 0, seen & (r != 0), sign > 0, seen]
            # Row k of a running total is what the first k rows hold.
            running = [np.concatenate(([0], np.cumsum(part))) for part in (gain, *counts)]
            for quantile in quantiles:
                k = math.ceil(quantile * len(rows))
                pnl, *numbers = (total[k] for total in running)
                found += [float(pnl), k, *map(int, numbers)]
        return found

    return grid


def _grid_by_blocks(
    panel: DataFrame, score: str, outcome: str, modes: Sequence[str], quantiles: Sequence[float], keys: Sequence[str], models: Sequence[str] | None
) -> DataFrame:
    """The same by one exchange and one sort; every group, which is small, meets in one NumPy block."""
    panel = _with_known_keys(panel, keys)
    scores = [score] if models is None else list(models)
    rows = panel.select(
        *keys, "Code", *[F.col(name).cast("double").alias(name) for name in scores], finite(F.col(outcome).cast("double")).alias("_realised")
    )
    names = [(f"{mode}_{index}_{part}", T.DoubleType() if part == "pnl" else T.LongType()) for mode in modes for index in range(len(quantiles)) for part in PARTS]
    grid, repeated = _grid_of_group(modes, quantiles), _repeats(keys)
    if models is None:
        return by_whole_groups(rows, keys, [score, "_realised"], grid, names, "Code", repeated)
    return by_whole_groups(rows, keys, ["_realised"], grid, names, "Code", repeated, each=("model", scores))


def backtest_grid(
    panel: DataFrame,
    score: str = "score",
    outcome: str = "return",
    modes: Sequence[str] = MODES,
    quantiles: Sequence[float] = QUANTILES,
    keys: Sequence[str] = ("model", "Date"),
    profile: GroupProfile | None = None,
    models: Sequence[str] | None = None,
) -> DataFrame:
    """Daily statistics of every (group, mode, quantile), dates without a selection included.

    One ranking serves the whole grid; rows are never multiplied by modes or quantiles.  Small groups are
    ranked and added up in NumPy blocks, larger ones by windows and conditional aggregates.  With *models* the panel is
    wide: each of these columns holds the scores of a model, *keys* and *profile* are those of the wide panel, and
    one exchange and one sort serve all models.
    """
    keys, modes = list(keys), [canonical_mode(mode) for mode in modes]
    quantiles = [canonical_quantile(quantile) for quantile in quantiles]
    scores = [score] if models is None else list(models)
    require_columns(panel, (*keys, "Code", *scores, outcome), "backtest panel")
    panel = panel.select(*keys, "Code", *scores, outcome)
    profile = profile or profile_groups(panel, keys)
    group = keys if models is None else ["model", *keys]
    if profile.fits_window:
        daily = _grid_by_blocks(panel, score, outcome, modes, quantiles, keys, models)
    else:
        if models is not None:
            panel, keys = panel.unpivot([*keys, "Code", outcome], scores, "model", score), group
        daily = _grid_by_aggregates(panel, score, outcome, modes, quantiles, keys, profile)
    cells = [
        F.struct(F.lit(mode).alias("mode"), F.lit(quantile).alias("quantile"), *[F.col(f"{mode}_{index}_{part}").alias(part) for part in PARTS])
        for mode in modes for index, quantile in enumerate(quantiles)
    ]
    daily = daily.select(*group, F.explode(F.array(*cells)).alias("c")).select(*group, "c.*")
    n = F.col("selected")

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)

    return daily.select(
        *group, "mode", "quantile", "pnl",
        n.cast("double").alias("notional"),
        share(F.col("pnl"), n).alias("ppd"),
        F.col("hits").alias("hit_count"),
        F.col("moves").alias("hit_denominator"),
        share(F.col("hits"), F.col("moves")).alias("hit_ratio"),
        F.col("longs").alias("long_count"),
        n.alias("position_count"),
        share(F.col("longs"), n).alias("long_share"),
        n.alias("selected_count"),
        F.col("observed").alias("observed_return_count"),
        (n - F.col("observed")).alias("missing_return_count"),
    )


def backtest_daily(
    panel: DataFrame, mode: str, quantile: float, score: str = "score", outcome: str = "return",
    keys: Sequence[str] = ("Date",), profile: GroupProfile | None = None,
) -> DataFrame:
    """One mode and quantile of :func:`backtest_grid`."""
    return backtest_grid(panel, score, outcome, [mode], [quantile], keys, profile)


def summary_aggregates() -> list[Column]:
    """Sufficient statistics of a set of daily rows."""
    return [
        F.sum("pnl").alias("pnl"),
        F.sum("notional").alias("notional"),
        F.avg("pnl").alias("_mean"),
        F.stddev_samp("pnl").alias("_sd"),
        F.sum("hit_count").alias("_hits"),
        F.sum("hit_denominator").alias("_moves"),
        F.sum("long_count").alias("_longs"),
        F.sum("position_count").alias("_positions"),
        F.avg("selected_count").alias("nr_instr"),
        F.sum("selected_count").alias("nr_trades"),
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(F.col("notional") == 0).alias("cash_days"),
    ]


def summary_columns() -> list[Column]:
    """Summary measures out of :func:`summary_aggregates`."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.nullif(F.col(b), F.lit(0))).otherwise(0.0)

    traded = (F.col("_sd") > 0) & (F.col("notional") != 0)
    sharpe = F.sqrt(F.lit(TRADING_DAYS)) * F.col("_mean") / F.nullif(F.col("_sd"), F.lit(0.0))
    return [
        F.col("pnl"),
        F.col("notional"),
        share("pnl", "notional").alias("ppd"),
        F.when(traded, sharpe).otherwise(0.0).alias("sharpe_ratio"),
        share("_hits", "_moves").alias("hit_ratio"),
        share("_longs", "_positions").alias("long_share"),
        F.col("nr_instr"),
        F.col("nr_trades"),
        F.col("n_days"),
        F.col("cash_days"),
    ]


#: The daily columns that a summary is made of.
DAILY_PARTS = ("pnl", "notional", "hit_count", "hit_denominator", "long_count", "position_count", "selected_count")


def daily_rows(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Daily rows that can be summarised: one per group and date, every part finite; anything else fails the job."""
    require_columns(daily, (*by, "Date", *DAILY_PARTS), "daily table")
    finite_parts = F.lit(True)
    for part in DAILY_PARTS:
        finite_parts = finite_parts & is_finite(F.col(part).cast("double"))
    single = F.count(F.lit(1)).alias("_same")
    rows = daily.groupBy(*by, "Date").agg(single, *[F.max(part).alias(part) for part in DAILY_PARTS])
    rows = rows.filter(row_guard(finite_parts, "a part of a daily row is missing or not finite"))
    return rows.filter(row_guard((F.col("_same") == 1) & F.col("Date").isNotNull(), "a summary takes one row a date")).drop("_same")


def summarise_daily(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary measures recomputed from daily rows, per group.

    Without groups an empty table fails the job; groups that do not occur give no row.
    """
    summed = daily_rows(daily, by).groupBy(*by).agg(*summary_aggregates())
    return summed.filter(row_guard(F.col("n_days") > 0, "there are no daily rows")).select(*by, *summary_columns())


def portfolio_summary(daily: DataFrame, period: str, by: Sequence[str] = ("model", "mode", "quantile")) -> DataFrame:
    """Summary per (model, mode, quantile), labelled with its period."""
    return summarise_daily(daily, by).select(F.lit(period).alias("period"), "*")


def _by_period(daily: DataFrame, by: Sequence[str], aggregates: Sequence[Column], label: str) -> DataFrame:
    """Aggregate per year and over all years at once with grouping sets."""
    dated = daily.withColumn("_year", _year_column(daily))
    groups = [F.col(name) for name in by]
    sets = dated.groupingSets([groups, [*groups, F.col("_year")]], *groups, F.col("_year"))
    summed = sets.agg(F.grouping("_year").alias("_all"), *aggregates)
    period = F.when(F.col("_all") == 1, label).otherwise(F.col("_year").cast("string"))
    return summed.withColumn("period", period)


def period_portfolio_summary(daily: DataFrame, label: str, by: Sequence[str] = ("model", "mode", "quantile")) -> DataFrame:
    """Portfolio summaries of the whole period (named *label*) and of every year, in one pass."""
    return _by_period(daily_rows(daily, by), by, summary_aggregates(), label).select("period", *by, *summary_columns())


def predictive_summary(daily: DataFrame, period: str) -> DataFrame:
    """Mean daily IC and rank IC per model."""
    means = daily.groupBy("model").agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"))
    return means.select(F.lit(period).alias("period"), "model", "ic", "rank_ic")


def period_predictive_summary(daily: DataFrame, label: str) -> DataFrame:
    """Mean IC and rank IC of the whole period and of every year, in one pass."""
    means = [F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic")]
    return _by_period(daily, ["model"], means, label).select("period", "model", "ic", "rank_ic")


def _year_column(frame: DataFrame) -> Column:
    return F.year("Date") if dict(frame.dtypes)["Date"] == "date" else F.floor(F.col("Date") / 10000)


def combine_rolling_years(
    first: DataFrame, second: DataFrame, years: tuple[int, int] = (2024, 2025), by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Concatenate two test years and recompute, never average, the summaries.

    Each table must cover exactly its year, with the same columns and groups.
    """
    if set(first.columns) != set(second.columns):
        raise ValueError("both daily tables must have the same columns")
    require_columns(first, (*by, "Date"), "daily table")
    for table, year in ((first, years[0]), (second, years[1])):
        if table.isEmpty():
            raise ValueError(f"{year} daily table is empty")
        require_empty(table.filter(_year_column(table) != year), f"expected only {year} rows")
    if by:
        one, two = first.select(*by).distinct(), second.select(*by).distinct()
        odd = one.exceptAll(two).unionByName(two.exceptAll(one))
        require_empty(odd, "both years must contain the same portfolio groups")
    combined = first.unionByName(second)
    repeated = combined.groupBy(*by, "Date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    require_empty(repeated, "duplicate rolling rows")
    return combined, summarise_daily(combined, by)
