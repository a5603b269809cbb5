"""Bar preparation: resampling, adjusted panels, and per-bar statistics."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as T
from ..functions import keys as K
from ..functions.safe import change, number, ratio, step_return
from ..session import compiled
from .contracts import require_columns, row_guard

OHLC = ("open", "high", "low", "close")


def _spelling(frame: DataFrame, name: str) -> Column:
    """Accept ``Code`` or ``code`` (and so on)."""
    if name in frame.columns:
        return F.col(name)
    require_columns(frame, [name.lower()], "bars")
    return F.col(name.lower())


def code_of(bars: DataFrame) -> Column:
    """The normalised code of a bar."""
    return K.normalize_code(_spelling(bars, "Code"))


def _date(frame: DataFrame) -> Column:
    column = _spelling(frame, "Date")
    return K.integer_date(column) if _is_integer(frame, "Date") else K.normalize_date(column)


def _minute(frame: DataFrame) -> Column:
    column = _spelling(frame, "Minute")
    return K.integer_minute(column) if _is_integer(frame, "Minute") else K.normalize_minute(column)


def _is_integer(frame: DataFrame, name: str) -> bool:
    kind = dict(frame.dtypes).get(name) or dict(frame.dtypes).get(name.lower())
    return kind in ("int", "bigint", "smallint")


def _factor(frame: DataFrame) -> Column:
    return F.coalesce(number(F.col("adj_factor")), F.lit(1.0)) if "adj_factor" in frame.columns else F.lit(1.0)


#: A packed order has two whole numbers below 2^63, joined in a decimal of 38 digits.
HALF = 1 << 63


def packed_order(ticks: DataFrame, order: Sequence[str]) -> Column | None:
    """One fixed-width number that sorts ticks as the columns of *order* do, equal only where all are equal.

    Each column counts as a digit whose base is the column's measured range (one pass over the order
    columns alone).  Fractions count in hundredths.  None if a column holds NULL, text or finer
    fractions, or if the ranges do not fit.
    """
    kinds = dict(ticks.dtypes)
    whole = {"tinyint", "smallint", "int", "bigint"}
    if not all(kinds.get(name) in whole | {"float", "double"} for name in order):
        return None
    digits = {n: F.col(n).cast("long") if kinds[n] in whole else F.round(F.col(n).cast("double") * 100).cast("long") for n in order}
    tests = [F.count_if(F.col(n).isNull()) for n in order]
    tests += [F.count_if(~F.coalesce(F.abs(F.col(n) * 100 - F.round(F.col(n) * 100)) < 1e-4, F.lit(False))) for n in order if kinds[n] not in whole]
    odd = sum(tests[1:], tests[0])
    seen = ticks.agg(odd.alias("odd"), *[f(c).alias(f"{s}{i}") for i, c in enumerate(digits.values()) for s, f in (("low", F.min), ("high", F.max))]).first()
    if seen["odd"] or seen["low0"] is None:
        return None
    halves, base = [F.lit(0).cast("long")], 1
    for i, digit in enumerate(digits.values()):
        span = seen[f"high{i}"] - seen[f"low{i}"] + 1
        if base * span >= HALF:
            halves, base = [*halves, F.lit(0).cast("long")], 1
        if len(halves) > 2 or span >= HALF:
            return None
        halves[-1] = halves[-1] * F.lit(span).cast("long") + (digit - F.lit(seen[f"low{i}"]).cast("long"))
        base *= span
    if len(halves) == 1:
        return halves[0]
    return (halves[0].cast("decimal(19,0)") * F.lit(Decimal(HALF)) + halves[1].cast("decimal(19,0)")).cast("decimal(38,0)")


def resample_bars(
    ticks: DataFrame, keys: Sequence[str], price: str, order: Sequence[str], sums: dict[str, Column]
) -> DataFrame:
    """Ticks or finer bars to OHLC bars plus summed columns.

    The first and last tick are found by a packed order, so that all aggregates are of fixed width and
    combine by hashing before the exchange: a key with very many ticks never gathers in one task, and
    no tick is sorted.  Where the order cannot be packed, the least and greatest (order, price) struct is
    taken, which sorts.  Ticks that agree in the whole order must agree in price.
    """
    packed = packed_order(ticks, order)
    if packed is None:
        tick = F.struct(*order, price)
        first, last = F.min(tick)[price], F.max(tick)[price]
    else:
        ticks = ticks.withColumn("_order", packed)
        first, last = F.min_by(price, "_order"), F.max_by(price, "_order")
    return ticks.groupBy(*keys).agg(
        first.alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        last.alias("close"),
        *[F.sum(column).alias(name) for name, column in sums.items()],
    )


def merge_bars(bars: DataFrame, keys: Sequence[str], order: str, volume: Column, amount: Column) -> DataFrame:
    """Coarser OHLCV bars from finer ones (for instance daily from minute bars)."""
    return bars.groupBy(*keys).agg(
        F.min_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        F.sum(volume).alias("vol"),
        F.sum(amount).alias("amount"),
    )


def prepare_daily_panel(bars: DataFrame, prefixes: Sequence[str] = K.CODE_PREFIXES) -> DataFrame:
    """Raw daily bars (vol in lots, amount in thousands) to the adjusted panel."""
    require_columns(bars, (*OHLC, "pre_close", "vol", "amount"), "daily bars")
    code = K.normalize_code(_spelling(bars, "Code"))
    kept = compiled(bars).withColumns(
        {
            "_code": code,
            "_date": _date(bars),
            "_factor": _factor(bars),
            "_vol": number(F.col("vol")),
            "_amount": number(F.col("amount")),
        }
    ).filter(K.has_prefix(F.col("_code"), prefixes))
    implied = ratio(F.col("_amount") * 1000.0, F.col("_vol") * 100.0)
    vwap = implied
    if "vwap" in bars.columns:
        given = number(F.col("vwap"))
        # A partly filled column is used as it is; only an entirely empty one is replaced.
        empty = kept.select((F.count(given) == 0).alias("empty")).scalar()
        vwap = F.when(empty, implied).otherwise(given)
    adjusted = {f"{name}_adj": number(F.col(name)) * F.col("_factor") for name in (*OHLC, "pre_close")}
    kept = kept.filter(row_guard(F.col("_date").isNotNull(), "daily bars contain invalid dates"))
    return kept.select(
        F.col("_code").alias("Code"),
        F.col("_date").alias("Date"),
        *[column.alias(name) for name, column in adjusted.items()],
        (vwap * F.col("_factor")).alias("vwap_adj"),
        (F.col("_vol") * 100.0).alias("volume_shares"),
        (F.col("_amount") * 1000.0 * F.col("_factor")).alias("amount_adj"),
        F.col("_factor").alias("adj_factor"),
    )


def prepare_minute_panel(bars: DataFrame, prefixes: Sequence[str] = K.CODE_PREFIXES) -> DataFrame:
    """Minute bars with normalised keys; prices are adjusted already, amount is not."""
    require_columns(bars, (*OHLC, "vol", "amount"), "minute bars")
    named = compiled(bars).withColumns(
        {
            "_code": K.normalize_code(_spelling(bars, "Code")),
            "_date": _date(bars),
            "_minute": _minute(bars),
        }
    ).filter(K.has_prefix(F.col("_code"), prefixes))
    named = named.filter(row_guard(F.col("_date").isNotNull(), "minute bars contain invalid dates"))
    named = named.filter(row_guard(F.col("_minute").isNotNull(), "minute bars contain invalid minutes"))
    return named.select(
        F.col("_code").alias("Code"),
        F.col("_date").alias("Date"),
        F.col("_minute").alias("Minute"),
        *[number(F.col(name)).alias(name) for name in (*OHLC, "vol")],
        (number(F.col("amount")) * _factor(bars)).alias("amount_adj"),
    )


def assign_slots(minutes: DataFrame) -> DataFrame:
    """Add the half-hour slot and drop minutes outside the sessions."""
    return minutes.withColumn("slot", K.session_slot(F.col("Minute"))).filter(F.col("slot").isNotNull())


def _first(column: str) -> str:
    return f"min_by({column}, CASE WHEN {column} IS NOT NULL THEN Minute END)"


def _last(column: str) -> str:
    return f"max_by({column}, CASE WHEN {column} IS NOT NULL THEN Minute END)"


def minute_returns(minutes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``ret`` (bar-to-bar inside the group) and deviations from group VWAP and open.

    A group holds at most one row per minute of one stock-day, so these windows
    are small by the key contract, whatever the table size; a repeated minute
    fails the job in the same pass.
    """
    group = Window.partitionBy(*keys)
    previous = F.lag("close").over(group.orderBy("Minute"))
    repeated = F.lag("Minute").over(group.orderBy("Minute")) == F.col("Minute")
    sums = minutes.withColumns(
        {
            "ret": step_return(F.col("close"), previous),
            "_repeated": F.coalesce(repeated, F.lit(False)),
            "_amount": F.coalesce(F.sum("amount_adj").over(group), F.lit(0.0)),
            "_vol": F.coalesce(F.sum("vol").over(group), F.lit(0.0)),
            "_open": F.expr(_first("open")).over(group),
        }
    )
    sums = sums.filter(row_guard(~F.col("_repeated"), "a stock has two bars of one minute"))
    return sums.withColumns(
        {
            "dev_vwap": change(F.col("close"), ratio(F.col("_amount"), F.col("_vol"))),
            "dev_open": change(F.col("close"), F.col("_open")),
        }
    ).drop("_amount", "_vol", "_open", "_repeated")


# Statistics of one bar over its minute rows (see ``minute_returns``).
BAR_STATISTICS = {
    "OPEN": _first("open"),
    "CLOSE": _last("close"),
    "HIGH": "max(high)",
    "LOW": "min(low)",
    "VOLUME": "coalesce(sum(vol), 0D)",
    "AMOUNT": "coalesce(sum(amount_adj), 0D)",
    "VOLUME_FIRST": _first("vol"),
    "VOLUME_LAST": _last("vol"),
    "VOLUME_MEAN": "avg(vol)",
    "AMOUNT_FIRST": _first("amount_adj"),
    "AMOUNT_LAST": _last("amount_adj"),
    "AMOUNT_MEAN": "avg(amount_adj)",
    "RET_N": "count(ret)",
    "RET_STD": "stddev_samp(ret)",
    "RET_SQUARES": "coalesce(sum(ret * ret), 0D)",
    "RET_ABS_MEAN": "avg(abs(ret))",
    "RET_MAX": "max(ret)",
    "RET_MIN": "min(ret)",
    "UP_N": "count_if(ret > 0)",
    "DOWN_N": "count_if(ret < 0)",
    "FLAT_N": "count_if(ret = 0)",
    "UP_VOL": "coalesce(sum(CASE WHEN ret > 0 THEN vol END), 0D)",
    "DOWN_VOL": "coalesce(sum(CASE WHEN ret < 0 THEN vol END), 0D)",
    "UP_AMT": "coalesce(sum(CASE WHEN ret > 0 THEN amount_adj END), 0D)",
    "DOWN_AMT": "coalesce(sum(CASE WHEN ret < 0 THEN amount_adj END), 0D)",
    "DEV_MEAN": "avg(dev_vwap)",
    "DEV_ABS_MEAN": "avg(abs(dev_vwap))",
    "DEV_STD": "stddev_samp(dev_vwap)",
    "DEV_MAX_OPEN": "max(dev_open)",
    "DEV_MIN_OPEN": "min(dev_open)",
}
# Correlated pairs: short row columns and the names they carry in the output.
SIDES = {"r": "RET", "ar": "ABSRET", "d": "PRICEDEV", "v": "VOL", "a": "AMT"}
PAIRS = [(x, y) for x in ("r", "ar", "d") for y in ("v", "a")]


def _pair_sums(x: str, y: str) -> dict[str, str]:
    """Sufficient sums of one pair over rows where both sides are finite.

    The product column ``x_y`` is NULL exactly where a side is missing, so it is the
    mask.  The absolute return shares mask and squares with the return.
    """
    product = f"{x}_{y}"
    sums = {"xy": f"sum({product})", "x": f"sum(CASE WHEN {product} IS NOT NULL THEN {x} END)"}
    if x != "ar":
        sums |= {
            "n": f"count({product})",
            "y": f"sum(CASE WHEN {product} IS NOT NULL THEN {y} END)",
            "xx": f"sum(CASE WHEN {product} IS NOT NULL THEN {x} * {x} END)",
            "yy": f"sum(CASE WHEN {product} IS NOT NULL THEN {y} * {y} END)",
        }
    return {f"{product}_{part}": text for part, text in sums.items()}


def _pair_correlation(x: str, y: str) -> str:
    """Pearson from the sums; NULL for fewer than two rows or a constant side."""
    base = "r" if x == "ar" else x
    n, sy, sxx, syy = (f"{base}_{y}_{part}" for part in ("n", "y", "xx", "yy"))
    sx, sxy = f"{x}_{y}_x", f"{x}_{y}_xy"
    spread = f"(({n} * {sxx} - {sx} * {sx}) * ({n} * {syy} - {sy} * {sy}))"
    return f"CASE WHEN {n} >= 2 AND {spread} > 0 THEN {T.ratio(f'({n} * {sxy} - {sx} * {sy})', f'sqrt({spread})')} END"


def bar_statistics(minutes: DataFrame, keys: Sequence[str], extra: dict[str, str] | None = None) -> DataFrame:
    """All statistics of one bar (a half-hour slot, or the two opening minutes).

    Expects columns ``Minute, open, high, low, close, vol, amount_adj``; one
    partitioning by *keys* serves the window and the aggregate.  *extra* adds
    aggregates to the same pass.
    """
    sides = {"r": "ret", "ar": "abs(ret)", "d": "dev_vwap", "v": "vol", "a": "amount_adj"}
    rows = minute_returns(compiled(minutes), keys)
    rows = rows.selectExpr("*", *[f"{T.finite(text)} AS {name}" for name, text in sides.items()])
    rows = rows.selectExpr("*", *[f"{x} * {y} AS {x}_{y}" for x, y in PAIRS])
    stats = BAR_STATISTICS | (extra or {})
    sums: dict[str, str] = {}
    for x, y in PAIRS:
        sums |= _pair_sums(x, y)
    bars = rows.groupBy(*keys).agg(*[F.expr(text).alias(name) for name, text in (stats | sums).items()])
    return bars.selectExpr(
        *keys,
        *stats,
        f"{T.ratio('AMOUNT', 'VOLUME')} AS VWAP",
        *[f"{_pair_correlation(x, y)} AS {SIDES[x]}_{SIDES[y]}_CORR" for x, y in PAIRS],
    )


def slot_bars(minutes: DataFrame) -> DataFrame:
    """Half-hour bars of every stock-day, with running measures over the day so far.

    One exchange by (Code, Date): the slot window, the slot aggregate and the
    running window are all satisfied by it.
    """
    # The early repartition keeps later per-slot grouping from hashing on the slot.
    placed = assign_slots(minutes).repartition("Code", "Date")
    return running_measures(bar_statistics(placed, ("Code", "Date", "slot")))


def running_measures(bars: DataFrame) -> DataFrame:
    """Previous *present* slot and cumulative measures of each stock-day (at most 8 rows)."""
    day = Window.partitionBy("Code", "Date").orderBy("slot")
    so_far = day.rowsBetween(Window.unboundedPreceding, 0)
    whole = day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def while_present(name: str, running: Column) -> Column:
        return F.when(F.col(name).isNotNull(), running)

    return bars.withColumns(
        {
            "PREV_CLOSE": F.lag("CLOSE").over(day),
            "PREV_VWAP": F.lag("VWAP").over(day),
            "PREV_VOLUME": F.lag("VOLUME").over(day),
            "PREV_AMOUNT": F.lag("AMOUNT").over(day),
            "CUM_HIGH": while_present("HIGH", F.max("HIGH").over(so_far)),
            "CUM_LOW": while_present("LOW", F.min("LOW").over(so_far)),
            "FIRST_OPEN": F.first("OPEN", ignorenulls=True).over(whole),
            "CUM_VWAP": ratio(F.sum("AMOUNT").over(so_far), F.sum("VOLUME").over(so_far)),
        }
    )


def early_open_bars(minutes: DataFrame) -> DataFrame:
    """The two-minute opening bar (09:30, 09:31) of every session, with the auction minute."""
    opening = minutes.filter(F.col("Minute").isin(930, 931)).repartition("Code", "Date")
    auction = {"AUCTION_PRICE": "close", "AUCTION_VOL": "vol", "AUCTION_AMT": "amount_adj"}
    return bar_statistics(
        opening, ("Code", "Date"), {name: f"max(CASE WHEN Minute = 930 THEN {c} END)" for name, c in auction.items()}
    )
