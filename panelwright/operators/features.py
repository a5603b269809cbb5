"""Feature families and raw protocol panels (E9-E13), for all dates in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions import formulas as T
from ..functions.keys import CODE_PREFIXES
from ..session import compiled
from .bars import early_open_bars, prepare_daily_panel, prepare_minute_panel, slot_bars
from .calendar import sessions
from .contracts import require_columns, row_guard, unique_guard

KEYS = ("Code", "Date")
# The reference-day columns intraday features are measured against.
REFERENCE = {
    "ref_close": "close_adj",
    "ref_pre_close": "pre_close_adj",
    "ref_volume": "volume_shares",
    "ref_amount": "amount_adj",
}
HISTORY = "OVER (PARTITION BY Code ORDER BY Date)"


def daily_lookbacks(adjusted: DataFrame) -> DataFrame:
    """Add lags and full-window sums, minima and maxima over 5, 20 and 60 rows of the stock.

    The 20-row values combine four 5-row values and the 60-row values three 20-row
    ones, so a row touches 5 + 4 + 3 neighbours instead of 60.  The three window
    layers share one exchange and one sort.  A stock has one row per session, so
    a partition is bounded by the length of the calendar.
    """
    five = "OVER (PARTITION BY Code ORDER BY Date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    close, high, low = (T.finite(name) for name in ("close_adj", "high_adj", "low_adj"))

    def full(aggregate: str, value: str) -> str:
        return f"CASE WHEN count({value}) {five} = 5 THEN {aggregate}({value}) {five} END"

    def lags(name: str, step: int, count: int) -> list[str]:
        return [name] + [f"lag({name}, {step * i}) {HISTORY}" for i in range(1, count)]

    def combined(how: str, parts: list[str]) -> str:
        if how == "sum":
            return " + ".join(parts)
        # lag of an incomplete window is NULL; the sum is NULL as soon as one part is.
        return f"CASE WHEN ({' + '.join(parts)}) IS NOT NULL THEN {how}({', '.join(parts)}) END"

    base = adjusted.selectExpr(
        "*",
        f"lag(Date, 1) {HISTORY} AS _before",
        f"lag(close_adj, 1) {HISTORY} AS close_lag1",
        *[f"lag(close_adj, {n}) {HISTORY} AS close_lag{n}" for n in (5, 10, 20, 60)],
        f"lag(vwap_adj, 1) {HISTORY} AS vwap_lag1",
        f"lag(volume_shares, 1) {HISTORY} AS volume_lag1",
        f"lag(amount_adj, 1) {HISTORY} AS amount_lag1",
        f"{full('sum', close)} AS close_sum5",
        f"{full('min', low)} AS low_min5",
        f"{full('max', high)} AS high_max5",
    )
    # A repeated key fails the job in the same pass, whatever columns are asked for.
    fresh = F.col("_before").isNull() | (F.col("_before") < F.col("Date"))
    base = base.filter(row_guard(fresh, "daily bars repeat a (Code, Date) key")).drop("_before")
    measures = (("close_sum", "sum"), ("low_min", "least"), ("high_max", "greatest"))
    twenty = base.selectExpr("*", *[f"{combined(how, lags(f'{m}5', 5, 4))} AS {m}20" for m, how in measures])
    return twenty.selectExpr("*", *[f"{combined(how, lags(f'{m}20', 20, 3))} AS {m}60" for m, how in measures])


def daily_features(adjusted: DataFrame, fields: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Daily features (all 39, or the named ``D1_*`` ones) of every stock-day.

    Look-backs count rows of the stock, not calendar sessions.
    """
    require_columns(adjusted, (*KEYS, "open_adj", "high_adj", "low_adj", "close_adj"), "adjusted daily panel")
    formulas = T.daily()
    names = list(fields) if fields is not None else list(R.DAILY_COLUMNS)
    return daily_lookbacks(compiled(adjusted)).selectExpr(
        *KEYS, *keep, *[f"{formulas[name.removeprefix('D1_')]} AS {name}" for name in names]
    )


def _reference(daily: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    rows = daily.selectExpr(*KEYS, *keep, *[f"{source} AS {name}" for name, source in REFERENCE.items()])
    return unique_guard(rows, KEYS, "the reference days repeat a (Code, Date) key")


def half_hour_fields(
    minutes: DataFrame, daily: DataFrame, fields: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Long half-hour features: one row per (Code, Date, slot), only reference days present."""
    own, derived = T.half_hour(), T.per_share()
    names = list(fields) if fields is not None else list(R.HALF_HOUR_FIELDS)
    needed = [name for name in own if name in names]
    if any(name in derived for name in names):
        needed += [name for name in ("RET_OC", "RANGE_OPEN", "VOL_SHARE", "AMT_SHARE") if name not in needed]
    joined = slot_bars(minutes).join(_reference(daily, keep), list(KEYS), "inner")
    joined = joined.selectExpr(*KEYS, "slot", *keep, *[f"{own[name]} AS {name}" for name in needed])
    return joined.selectExpr(*KEYS, "slot", *keep, *[f"{derived.get(name, name)} AS {name}" for name in names])


def packed_slots(long: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Slot rows to one row a stock-day with a struct ``s<slot>`` of FLOAT fields for each slot; absent slots are NULL.

    The aggregate has eight buffers instead of one per output column, and the (Code, Date) partitioning is reused.
    """
    members = ", ".join(f"'{field}', CAST({T.finite(field)} AS FLOAT)" for field in fields)
    packed = long.selectExpr(*KEYS, "slot", *keep, f"named_struct({members}) AS packed")
    return packed.groupBy(*KEYS).agg(
        *[F.first(name).alias(name) for name in keep],
        *[F.expr(f"first(packed) FILTER (WHERE slot = {slot})").alias(f"s{slot}") for slot in R.SLOTS],
    )


def slot_columns(fields: Sequence[str]) -> list[str]:
    """``M30_<field>_<slot>`` columns out of :func:`packed_slots`."""
    return [f"s{slot}.{field} AS M30_{field}_{slot}" for field in fields for slot in R.SLOTS]


def pivot_slots(long: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Slot rows to ``M30_<field>_<slot>`` columns; absent slots are NULL."""
    return packed_slots(long, fields, keep).selectExpr(*KEYS, *keep, *slot_columns(fields))


def half_hour_features(minutes: DataFrame, daily: DataFrame) -> DataFrame:
    """The 560 half-hour features of every stock-day with minute bars and a daily row."""
    return pivot_slots(half_hour_fields(minutes, daily), R.HALF_HOUR_FIELDS)


def early_open_features(minutes: DataFrame, daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """Early-open features keyed by the *signal* date: the session before the opening bars."""
    opening = early_open_bars(minutes).withColumnRenamed("Date", "entry_date")
    days = sessions(calendar).select("Date", "entry_date").filter(F.col("entry_date").isNotNull())
    bars = opening.join(F.broadcast(days), "entry_date").drop("entry_date")  # one row per trading day
    formulas = T.early_open()
    fields = bars.join(_reference(daily), list(KEYS), "left").selectExpr(
        *KEYS, *[f"{formulas[name]} AS EO_{name}" for name in R.EARLY_OPEN_FIELDS]
    )
    return fields.selectExpr(*KEYS, *[f"CAST({T.finite(name)} AS FLOAT) AS {name}" for name in R.EARLY_OPEN_COLUMNS])


def raw_feature_panel(
    daily_bars: DataFrame,
    minute_bars: DataFrame,
    protocol: str = "o2o",
    calendar: DataFrame | None = None,
    prefixes: Sequence[str] = CODE_PREFIXES,
) -> DataFrame:
    """Raw panel of every signal date: 599 (o2o) or 657 (de) FLOAT features.

    The daily features ride through the slot join as one struct, so daily and
    half-hour data meet in a single (Code, Date) join.  Slots and early-open features
    stay structs as well until the last select: joins see a dozen columns, not 657.
    """
    key = R.protocol_key(protocol)
    daily = prepare_daily_panel(daily_bars, prefixes)
    minutes = prepare_minute_panel(minute_bars, prefixes)
    members = ", ".join(f"'{name}', CAST({T.finite(name)} AS FLOAT)" for name in R.DAILY_COLUMNS)
    features = daily_features(daily, keep=list(REFERENCE.values()))
    features = features.selectExpr(*KEYS, *REFERENCE.values(), f"named_struct({members}) AS daily")
    panel = packed_slots(half_hour_fields(minutes, features, keep=["daily"]), R.HALF_HOUR_FIELDS, keep=["daily"])
    columns = [*slot_columns(R.HALF_HOUR_FIELDS), "daily.*"]
    if key == "de":
        calendar = calendar if calendar is not None else daily.select("Date").distinct()
        opening = early_open_features(minutes, daily, calendar).select(*KEYS, F.struct(*R.EARLY_OPEN_COLUMNS).alias("opening"))
        panel = panel.join(opening, list(KEYS), "left")
        columns.append("opening.*")
    return panel.selectExpr(*KEYS, *columns).select(*KEYS, *R.raw_columns(key))


def project_features(frame: DataFrame, manifest: R.FeatureManifest) -> DataFrame:
    """Keys plus the manifest columns, in order."""
    require_columns(frame, (*KEYS, *manifest.columns), "source panel")
    return frame.select(*KEYS, *manifest.columns)


def project_protocol_features(frame: DataFrame, protocol: str, names: Sequence[str] | None = None) -> DataFrame:
    """Project onto the built-in manifest of *protocol* (or an explicit name list)."""
    return project_features(frame, R.manifest_of(protocol, names))
