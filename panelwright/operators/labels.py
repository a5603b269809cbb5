"""Forward VWAP-return labels (H2-H6)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.safe import change, finite, is_finite, number, ratio
from ..registry import protocol_key
from ..session import stage
from .bars import _date, _factor, _minute, _spelling
from .calendar import sessions
from .contracts import checked, require_columns
from .groups import GroupProfile, profile_groups, with_group_stats


@dataclass(frozen=True)
class LabelSpec:
    """Minutes and column names of one label protocol."""

    protocol: str
    entry_minutes: tuple[int, ...]
    exit_minutes: tuple[int, ...]
    raw_column: str
    target_column: str


# The label contracts of the two protocols.
LABELS = {
    "o2o": LabelSpec(
        "o2o",
        (930, 931, 932, 933, 934, 935),
        (930, 931, 932, 933, 934, 935),
        "oto_d1_open6_to_open6",
        "oto_d1_open6_to_open6_zscore",
    ),
    "de": LabelSpec(
        "de",
        (933, 934, 935),
        (930, 931, 932, 933, 934, 935),
        "oto_gap_d1_open3_to_open6",
        "oto_gap_d1_open3_to_open6_zscore",
    ),
}


def label_spec(protocol: str) -> LabelSpec:
    return LABELS[protocol_key(protocol)]


def _vwap(amount: Column, volume: Column) -> Column:
    return ratio(10.0 * F.sum(amount), F.sum(volume))


def _keyed(bars: DataFrame) -> DataFrame:
    require_columns(bars, ("amount", "vol"), "bars")
    code = K.normalize_code(_spelling(bars, "Code"))
    keyed = bars.select(
        code.alias("Code"),
        *([_date(bars).alias("Date")] if "Date" in bars.columns or "date" in bars.columns else []),
        *([_minute(bars).alias("Minute")] if "Minute" in bars.columns or "minute" in bars.columns else []),
        (number(F.col("amount")) * _factor(bars)).alias("_amount"),
        number(F.col("vol")).alias("_vol"),
    )
    return keyed


def adjusted_vwap(
    bars: DataFrame,
    minutes: Sequence[int] | None = None,
    output: str = "adjusted_vwap",
    keys: Sequence[str] = ("Code", "Date"),
) -> DataFrame:
    """``10 * sum(amount * adj_factor) / sum(vol)`` per key over selected minutes."""
    keyed = _keyed(bars)
    if minutes is not None:
        require_columns(keyed, ["Minute"], "bars")
        keyed = keyed.filter(F.col("Minute").isin(*minutes))
    valid = checked(F.col("Code"), F.col("Code").isNotNull(), "bars contain invalid security codes")
    return keyed.withColumn("Code", valid).groupBy(*keys).agg(_vwap(F.col("_amount"), F.col("_vol")).alias(output))


def entry_exit_vwaps(bars: DataFrame, protocol: str) -> DataFrame:
    """Both label VWAPs of every stock-session in one pass; flags tell which side has bars."""
    spec = label_spec(protocol)
    keyed = _keyed(bars).filter(F.col("Minute").isin(*sorted({*spec.entry_minutes, *spec.exit_minutes})))
    aggregates = []
    for side, minutes in (("entry", spec.entry_minutes), ("exit", spec.exit_minutes)):
        chosen = F.col("Minute").isin(*minutes)
        aggregates += [
            _vwap(F.when(chosen, F.col("_amount")), F.when(chosen, F.col("_vol"))).alias(f"{side}_vwap"),
            F.count_if(chosen).alias(f"{side}_bars"),
        ]
    valid = checked(F.col("Code"), F.col("Code").isNotNull(), "bars contain invalid security codes")
    return keyed.withColumn("Code", valid).groupBy("Code", "Date").agg(*aggregates)


def forward_returns(bars: DataFrame, protocol: str, calendar: DataFrame | None = None) -> DataFrame:
    """``Code, Date(signal), raw return``: entry one session after the signal, exit two.

    The exit is the stock's next row when that row is the next session, so no
    self-join is needed.  A stock has one row per session in the window.
    """
    spec = label_spec(protocol)
    vwaps = entry_exit_vwaps(bars, protocol)
    days = sessions(calendar if calendar is not None else bars.select(_date(bars).alias("Date")))
    days = days.filter(F.col("exit_date").isNotNull()).select(F.col("Date").alias("signal"), "entry_date", "exit_date")
    stock = Window.partitionBy("Code").orderBy("Date")
    following = vwaps.select(
        "Code",
        F.col("Date").alias("entry_date"),
        "entry_vwap",
        "entry_bars",
        F.lead(F.struct("Date", "exit_vwap", "exit_bars")).over(stock).alias("next"),
    )
    matched = following.join(F.broadcast(days), "entry_date").filter(  # one row per trading day
        (F.col("entry_bars") > 0) & (F.col("next.Date") == F.col("exit_date")) & (F.col("next.exit_bars") > 0)
    )
    raw = change(F.col("next.exit_vwap"), F.col("entry_vwap")).cast("float")
    return matched.select("Code", F.col("signal").alias("Date"), raw.alias(spec.raw_column))


def zscore_by_date(
    frame: DataFrame,
    raw: str,
    target: str,
    date: str = "Date",
    profile: GroupProfile | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Add the within-date sample z-score of finite values (of rows in *where*), FLOAT."""
    value = finite(number(F.col(raw)))
    value = value if where is None else F.when(where, value)
    with_value = frame.withColumn("_value", value)
    stats = {"_n": F.count("_value"), "_mean": F.avg("_value"), "_sd": F.stddev_samp("_value")}
    scored = with_group_stats(with_value, [date], stats, profile)
    z = F.when((F.col("_n") >= 2) & is_finite(F.col("_sd")) & (F.col("_sd") > 0),
               (F.col("_value") - F.col("_mean")) / F.col("_sd"))
    return scored.withColumn(target, z.cast("float")).drop("_value", "_n", "_mean", "_sd")


def build_labels(
    bars: DataFrame, protocol: str, calendar: DataFrame | None = None, signal_dates: DataFrame | None = None
) -> DataFrame:
    """Label table ``Code, Date, raw, target`` of every signal date in one job.

    The scan over minute bars is staged as one small row per stock-day before the
    per-date passes.
    """
    spec = label_spec(protocol)
    returns = forward_returns(bars, protocol, calendar)
    if signal_dates is not None:
        returns = returns.join(F.broadcast(signal_dates.select("Date").distinct()), "Date", "left_semi")
    returns = stage(returns.select("Code", "Date", spec.raw_column))
    labelled = zscore_by_date(
        returns, spec.raw_column, spec.target_column, profile=profile_groups(returns, ["Date"])
    )
    return labelled.select("Code", "Date", spec.raw_column, spec.target_column)


def build_o2o_labels(bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    return build_labels(bars, "o2o", calendar)


def build_de_labels(bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    return build_labels(bars, "de", calendar)
