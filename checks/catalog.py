"""Registered queries: every operator run over the derived tables, for all dates at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright import registry as R
from panelwright.functions import keys as K
from panelwright.functions.safe import change
from panelwright.operators import bars as B
from panelwright.operators import calendar as C
from panelwright.operators import contracts, features, labels, learn, metrics, normalize, portfolio, predictions, sequences, universe
from panelwright.plans import adapters as A
from panelwright.plans import jobs
from panelwright.session import shared_folder, stage

from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}
DIGITS = 6


def query(name: str, sql: str | None):
    """Register a query with its SQL twin (None: no SQL form)."""

    def add(function: Query) -> Query:
        CATALOG[name] = (function, None if sql is None else O.tie_free(sql))
        return function

    return add


def rounded(frame: DataFrame, digits: int = DIGITS, only: Sequence[str] | None = None) -> DataFrame:
    """Round fractional columns, so that summation order does not show.

    The offset keeps exact decimals ending in 5 away from the rounding edge.  ``floor`` gives a whole number of
    64 bits, so infinities, NaN and values beyond 2^52, which have no fraction, pass as they are.
    """
    kinds = dict(frame.dtypes)
    fractional = [c for c in frame.columns if kinds[c] in ("float", "double") and (only is None or c in only)]

    def shown(name: str) -> str:
        scaled = f"(CAST(`{name}` AS DOUBLE) * 1e{digits}D + 0.5001D)"
        return f"CASE WHEN abs({scaled}) < {float(1 << 52)!r}D THEN CAST(floor({scaled}) AS DOUBLE) ELSE {scaled} END / 1e{digits}D AS `{name}`"

    return frame.selectExpr(*[shown(c) if c in fractional else f"`{c}`" for c in frame.columns])


# ---- derived inputs -------------------------------------------------------------------------------------------
def adjusted_daily(spark: SparkSession, sf: str) -> DataFrame:
    return B.prepare_daily_panel(A.daily_bars(spark, sf))


def minute_panel(spark: SparkSession, sf: str) -> DataFrame:
    return B.prepare_minute_panel(A.minute_bars(spark, sf))


def intraday_reference(spark: SparkSession, sf: str) -> DataFrame:
    return B.prepare_daily_panel(A.intraday_daily_bars(A.minute_bars(spark, sf)))


SCORE_FIELDS = {
    "lgb": "-D1_RET_5D", "xgb": "-D1_RET_CC_1D", "mlp": "D1_MA_DEV_5D", "kan": "D1_CLOSE_VWAP", "gru": "D1_DIST_HIGH_20D",
    "tcn": "D1_CLOSE_POS - 0.5D", "transformer": "D1_GAP", "mamba": "D1_VOL_CHG_1D",
}


def score_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Wide scores of eight models (signs of daily features plus integer noise) and the next close return."""
    fields = [name.lstrip("-").split(" ")[0] for name in SCORE_FIELDS.values()]
    base = features.daily_features(adjusted_daily(spark, sf), fields, keep=["close_adj"])
    ahead = "lead(close_adj) OVER (PARTITION BY Code ORDER BY Date)"
    scored = base.selectExpr(
        "Code", "Date",
        *[
            f"coalesce({text}, 0) + ((CAST(Code AS INT) * {37 + i} + Date * {11 + 2 * i}) % 1009 - 504) * 1e-7D AS {model}"
            for i, (model, text) in enumerate(SCORE_FIELDS.items())
        ],
        f"CASE WHEN abs(close_adj) > 1e-12D THEN {ahead} / close_adj - 1D END AS raw_return",
    )
    return scored


def cross_sections(panel: DataFrame) -> DataFrame:
    """The dates on which ranks can be compared: those with two stocks at least."""
    panel = stage(panel)
    sizes = panel.groupBy("Date").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    return panel.join(sizes, "Date", "left_semi")


def long_scores(panel: DataFrame) -> DataFrame:
    return panel.unpivot(["Date", "Code", "raw_return"], list(SCORE_FIELDS), "model", "score")


def with_int_date(frame: DataFrame) -> DataFrame:
    return frame.withColumn("Date", F.date_format("Date", "yyyyMMdd").cast("int"))


# ---- keys and contracts ---------------------------------------------------------------------------------------
@query("code_normalize", """
WITH raw AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN ' ' || c_custkey || '.SZ '
  WHEN 2 THEN c_name WHEN 3 THEN 'ab-' || c_custkey || '_x.L' WHEN 4 THEN CAST(c_custkey + 1000000 AS VARCHAR) ELSE '' END AS raw FROM customer),
s AS (SELECT *, split_part(trim(raw), '.', 1) AS stem FROM raw)
SELECT c_custkey, CASE WHEN regexp_full_match(stem, '[0-9]{1,6}') THEN lpad(stem, 6, '0')
  WHEN regexp_full_match(stem, '[A-Za-z][A-Za-z0-9_-]{0,31}') THEN upper(stem) END AS Code FROM s""")
def code_normalize(spark, sf):
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    raw = (
        F.when(key % 6 == 0, text).when(key % 6 == 1, F.concat(F.lit(" "), text, F.lit(".SZ "))).when(key % 6 == 2, F.col("c_name"))
        .when(key % 6 == 3, F.concat(F.lit("ab-"), text, F.lit("_x.L"))).when(key % 6 == 4, (key + 1000000).cast("string")).otherwise("")
    )
    return A.table(spark, sf, "customer").select("c_custkey", K.normalize_code(raw).alias("Code"))


@query("date_normalize", """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d')
  WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d 00:00:00') WHEN 3 THEN strftime(o_orderdate, '%Y%m') || '99' ELSE strftime(o_orderdate, '%Y%m') END AS raw FROM orders),
d AS (SELECT o_orderkey, left(regexp_replace(raw, '[^0-9]', '', 'g'), 8) AS dd FROM t)
SELECT o_orderkey, CASE WHEN length(dd) = 8 THEN CAST(dd AS INT) END AS Date,
  CASE WHEN length(dd) = 8 THEN strftime(try_strptime(dd, '%Y%m%d'), '%Y-%m-%d') END AS day,
  CASE WHEN length(dd) = 8 THEN CAST(dd AS INT) // 10000 END AS year FROM d""")
def date_normalize(spark, sf):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = (
        F.when(key % 5 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 5 == 1, F.date_format(day, "yyyyMMdd"))
        .when(key % 5 == 2, F.date_format(day, "yyyy/MM/dd 00:00:00")).when(key % 5 == 3, F.concat(F.date_format(day, "yyyyMM"), F.lit("99")))
        .otherwise(F.date_format(day, "yyyyMM"))
    )
    return A.table(spark, sf, "orders").select(
        "o_orderkey", K.normalize_date(raw).alias("Date"),
        F.date_format(K.normalize_datetime(raw), "yyyy-MM-dd").alias("day"), K.year_of(K.normalize_date(raw)).alias("year"),
    )


@query("minute_normalize", """
WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%H:%M') WHEN 1 THEN strftime(ts, '%H:%M:%S')
  WHEN 2 THEN CAST(hour(ts) * 100 + minute(ts) AS VARCHAR) WHEN 3 THEN CAST(hour(ts) * 100 + minute(ts) AS VARCHAR) || '.0'
  WHEN 4 THEN CAST(hour(ts) * 100 + 60 + minute(ts) % 40 AS VARCHAR) ELSE strftime(ts, '%H:%M:%S') || '.250' END AS raw FROM events)
SELECT event_id, CASE WHEN event_id % 6 <> 4 THEN CASE WHEN contains(raw, ':') THEN CAST(left(raw, 2) AS INT) * 100 + CAST(substr(raw, 4, 2) AS INT)
  ELSE CAST(CAST(raw AS DOUBLE) AS INT) END END AS Minute FROM t""")
def minute_normalize(spark, sf):
    key, ts = F.col("event_id"), F.col("ts")
    hhmm = F.hour(ts) * 100 + F.minute(ts)
    raw = (
        F.when(key % 6 == 0, F.date_format(ts, "HH:mm")).when(key % 6 == 1, F.date_format(ts, "HH:mm:ss")).when(key % 6 == 2, hhmm.cast("string"))
        .when(key % 6 == 3, F.concat(hhmm.cast("string"), F.lit(".0")))
        .when(key % 6 == 4, (F.hour(ts) * 100 + 60 + F.minute(ts) % 40).cast("string"))
        .otherwise(F.concat(F.date_format(ts, "HH:mm:ss"), F.lit(".250")))
    )
    return A.table(spark, sf, "events").select("event_id", K.normalize_minute(raw).alias("Minute"))


@query("key_violations", """
WITH k AS (SELECT CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_suppkey END AS Code, l_shipdate AS Date FROM lineitem),
g AS (SELECT Code, Date, count(*) AS n FROM k GROUP BY Code, Date)
SELECT CASE WHEN Code IS NULL OR Date IS NULL THEN 'null_key' ELSE 'duplicate_key' END AS "check", count(*) AS n_keys, sum(n)::BIGINT AS n_rows
FROM g WHERE Code IS NULL OR Date IS NULL OR n > 1 GROUP BY 1""")
def key_violations(spark, sf):
    code = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey"))
    return contracts.key_violations(A.table(spark, sf, "lineitem").select(code.alias("Code"), F.col("l_shipdate").alias("Date")))


@query("duplicate_keys", """
SELECT CAST(l_suppkey AS BIGINT) AS Code, CAST(year(l_shipdate)*10000 + month(l_shipdate)*100 + day(l_shipdate) AS INT) AS Date, count(*) AS n_rows
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    ticks = A.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("Code"), A._date_int(F.col("l_shipdate")).alias("Date"))
    return contracts.duplicate_keys(ticks)


@query("contract_report", """
WITH a AS (SELECT CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_suppkey END AS k, l_shipdate AS d, CASE WHEN l_linenumber <> 6 THEN l_extendedprice END AS v FROM lineitem),
b AS (SELECT user_id AS k, ts AS d, CASE WHEN event_id % 11 <> 0 THEN value END AS v FROM events),
c AS (SELECT o_orderkey AS k, o_orderdate AS d, o_totalprice AS v FROM orders),
g AS (SELECT 'ticks' AS frame, k, d::VARCHAR AS d, count(*) AS n, count(*) - count(v) AS bad FROM a GROUP BY ALL
  UNION ALL SELECT 'events', k, d::VARCHAR, count(*), count(*) - count(v) FROM b GROUP BY ALL UNION ALL SELECT 'orders', k, d::VARCHAR, count(*), count(*) - count(v) FROM c GROUP BY ALL)
SELECT frame, 'null_key' AS rule, count(*) AS n_keys, sum(n)::BIGINT AS n_rows FROM g WHERE k IS NULL OR d IS NULL GROUP BY 1
UNION ALL SELECT frame, 'duplicate_key', count(*), sum(n)::BIGINT FROM g WHERE k IS NOT NULL AND d IS NOT NULL AND n > 1 GROUP BY 1
UNION ALL SELECT frame, 'non_finite', count(*), sum(bad)::BIGINT FROM g WHERE bad > 0 GROUP BY 1""")
def contract_report(spark, sf):
    ticks = A.table(spark, sf, "lineitem").select(
        F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("Code"), F.col("l_shipdate").alias("Date"),
        F.when(F.col("l_linenumber") != 6, F.col("l_extendedprice")).alias("price"),
    )
    events = A.table(spark, sf, "events").select(F.col("user_id").alias("Code"), F.col("ts").alias("Date"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("price"))
    orders = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("Code"), F.col("o_orderdate").alias("Date"), F.col("o_totalprice").alias("price"))
    frames = {"ticks": ticks, "events": events, "orders": orders}
    return contracts.contract_report({name: (frame, ("Code", "Date"), ("price",)) for name, frame in frames.items()})


# ---- bars -----------------------------------------------------------------------------------------------------
_BAR = ("open", "high", "low", "close")


@query("daily_bars", O.cte(O.DAILY) + "SELECT Code, Date, " + ", ".join(O.r(c, c) for c in (*_BAR, "pre_close", "vol", "amount", "adj_factor")) + " FROM daily")
def daily_bars(spark, sf):
    return rounded(A.daily_bars(spark, sf))


@query("minute_bars", O.cte(O.MINUTES) + "SELECT Code, Date, Minute, " + ", ".join(O.r(c, c) for c in (*_BAR, "vol", "amount", "adj_factor")) + " FROM minutes")
def minute_bars(spark, sf):
    return rounded(A.minute_bars(spark, sf))


@query("intraday_daily_bars", O.cte(O.MINUTES, O.INTRADAY) + "SELECT Code, Date, " + ", ".join(O.r(c, c) for c in (*_BAR, "pre_close", "vol", "amount", "adj_factor")) + " FROM intraday")
def intraday_daily_bars(spark, sf):
    return rounded(A.intraday_daily_bars(A.minute_bars(spark, sf)))


_ADJ = ("open_adj", "high_adj", "low_adj", "close_adj", "pre_close_adj", "vwap_adj", "volume_shares", "amount_adj", "adj_factor")


@query("adjusted_daily_panel", O.cte(O.DAILY, O.adjusted("daily")) + "SELECT Code, Date, " + ", ".join(O.r(c, c) for c in _ADJ) + " FROM adj")
def adjusted_daily_panel(spark, sf):
    return rounded(adjusted_daily(spark, sf))


# ---- daily features -------------------------------------------------------------------------------------------
_GROUPS = {
    "d1_candles": [c for c in R.DAILY_COLUMNS[:25] if c[3:] not in ("RET_CC_1D", "GAP", "RET_VWAP_1D", "VOL_CHG_1D", "AMT_CHG_1D")],
    "d1_lags": [f"D1_{n}" for n in ("RET_CC_1D", "GAP", "RET_VWAP_1D", "VOL_CHG_1D", "AMT_CHG_1D", "RET_5D", "RET_10D", "RET_20D", "RET_60D", "REV_1D")],
    "d1_moving_average": [f"D1_MA_DEV_{n}D" for n in (5, 20, 60)],
    "d1_range_position": list(R.DAILY_COLUMNS[33:]),
    "d1_all": list(R.DAILY_COLUMNS),
}


def _register_daily(name: str, fields: list[str]) -> None:
    @query(name, O.d1_query(fields))
    def run(spark, sf):
        return rounded(features.daily_features(adjusted_daily(spark, sf), fields))


for _name, _fields in _GROUPS.items():
    _register_daily(_name, _fields)


# ---- half-hour bars -------------------------------------------------------------------------------------------
_SLOT_QUERIES = {
    "slot_bars": {"OPEN": "o", "CLOSE": "c", "HIGH": "h", "LOW": "l", "VOLUME": "vol", "AMOUNT": "amt", "VWAP": "vw", "VOLUME_FIRST": "vf",
                  "VOLUME_LAST": "vl", "VOLUME_MEAN": "vm", "AMOUNT_FIRST": "af", "AMOUNT_LAST": "al", "AMOUNT_MEAN": "am"},
    "slot_minute_returns": {"RET_N": "rn", "RET_STD": "rsd", "RET_SQUARES": "rsq", "RET_ABS_MEAN": "rabs", "RET_MAX": "rmax", "RET_MIN": "rmin"},
    "slot_up_down_ratios": {"UP_N": "un", "DOWN_N": "dn", "FLAT_N": "fn", "UP_VOL": "uv", "DOWN_VOL": "dv", "UP_AMT": "ua", "DOWN_AMT": "da"},
    "slot_deviation_stats": {"DEV_MEAN": "dmean", "DEV_ABS_MEAN": "dabs", "DEV_STD": "dsd", "DEV_MAX_OPEN": "domax", "DEV_MIN_OPEN": "domin"},
    "slot_correlations": {"RET_VOL_CORR": "crv", "RET_AMT_CORR": "cra", "ABSRET_VOL_CORR": "cav", "ABSRET_AMT_CORR": "caa", "PRICEDEV_VOL_CORR": "cdv", "PRICEDEV_AMT_CORR": "cda"},
    "slot_cumulative": {"PREV_CLOSE": "pc", "PREV_VWAP": "pvw", "PREV_VOLUME": "pvol", "PREV_AMOUNT": "pamt", "CUM_HIGH": "ch", "CUM_LOW": "cl",
                        "FIRST_OPEN": "fo", "CUM_VWAP": O.q("camt", "cvol")},
}


def _register_slots(name: str, fields: dict[str, str]) -> None:
    @query(name, O.slot_query(fields))
    def run(spark, sf):
        bars = B.slot_bars(minute_panel(spark, sf)).selectExpr("Code", "Date", "slot", *[f"CAST({f} AS DOUBLE) AS {f}" for f in fields])
        return rounded(bars)


for _name, _slot_fields in _SLOT_QUERIES.items():
    _register_slots(_name, _slot_fields)

_PER_SHARE = [f"{kind}_PER_{unit}" for kind in ("RET", "ABS_RET", "RANGE") for unit in ("VOL", "AMT")] + ["VOL_SHARE", "AMT_SHARE"]
_M30_QUERIES = {
    "m30_shape_fields": [f for f in R.HALF_HOUR_FIELDS if f not in _PER_SHARE],
    "m30_per_volume_fields": _PER_SHARE,
}


def _register_m30(name: str, fields: list[str]) -> None:
    @query(name, O.m30_query(fields))
    def run(spark, sf):
        return rounded(features.half_hour_fields(minute_panel(spark, sf), intraday_reference(spark, sf), fields))


for _name, _fields in _M30_QUERIES.items():
    _register_m30(_name, _fields)


@query("m30_wide_pivot", O.cte(*O.M30_CHAIN, O.m30_long(), O.m30_wide(list(R.HALF_HOUR_FIELDS))) + "SELECT Code, Date, " + ", ".join(O.rf(c, c) for c in R.HALF_HOUR_COLUMNS) + " FROM wide")
def m30_wide_pivot(spark, sf):
    return rounded(features.half_hour_features(minute_panel(spark, sf), intraday_reference(spark, sf)))


_EO_BARS = {"OPEN": "o", "CLOSE": "c", "HIGH": "h", "LOW": "l", "VOLUME": "vol", "AMOUNT": "amt", "VWAP": "vw", "AUCTION_PRICE": "ap",
            "AUCTION_VOL": "av", "AUCTION_AMT": "aa", "RET_N": "rn", "RET_SQUARES": "rsq"}


@query("early_open_bars", O.cte(O.MINUTES, *O.EO_CHAIN[:2]) + "SELECT Code, Date, " + ", ".join(O.r(x, n) for n, x in _EO_BARS.items()) + " FROM ebars")
def early_open_bars(spark, sf):
    bars = B.early_open_bars(minute_panel(spark, sf))
    return rounded(bars.selectExpr("Code", "Date", *[f"CAST({f} AS DOUBLE) AS {f}" for f in _EO_BARS]))


@query("early_open_fields", O.early_query())
def early_open_fields(spark, sf):
    minutes = minute_panel(spark, sf)
    return rounded(features.early_open_features(minutes, intraday_reference(spark, sf), A.calendar_of(minutes)))


def raw_panel(spark: SparkSession, sf: str, protocol: str) -> DataFrame:
    minutes = A.minute_bars(spark, sf)
    return features.raw_feature_panel(A.intraday_daily_bars(minutes), minutes, protocol)


def _register_raw(protocol: str) -> None:
    names = (list(R.HALF_HOUR_FIELDS), list(R.DAILY_FIELDS), list(R.EARLY_OPEN_FIELDS))
    columns = list(R.raw_columns(protocol))

    @query(f"raw_panel_{protocol}", O.raw_query(protocol, columns, *names))
    def raw(spark, sf):
        return rounded(raw_panel(spark, sf, protocol))

    kept = [name.removesuffix("_mad3_zscore") for name in R.manifest_of(protocol).columns]

    @query(f"manifest_projection_{protocol}", O.normalised_query(O.raw_chain(protocol, *names), "raw", columns, kept))
    def normalised(spark, sf):
        panel = stage(raw_panel(spark, sf, protocol))
        return rounded(features.project_protocol_features(normalize.mad_zscore(panel), protocol))


for _protocol in R.PROTOCOLS:
    _register_raw(_protocol)


@query("mad3_zscore", O.normalised_query((O.DAILY, O.adjusted("daily"), O.lookback(), "raw AS (SELECT Code, Date, " + ", ".join(f"({x})::FLOAT AS D1_{n}" for n, x in O.D1.items()) + " FROM look)"), "raw", list(R.DAILY_COLUMNS)))
def mad3_zscore(spark, sf):
    raw = features.daily_features(adjusted_daily(spark, sf))
    return rounded(normalize.mad_zscore(stage(raw.selectExpr("Code", "Date", *[f"CAST({c} AS FLOAT) AS {c}" for c in R.DAILY_COLUMNS]))))


# ---- labels ---------------------------------------------------------------------------------------------------
@query("adjusted_vwap", O.cte(O.MINUTES, O.vwap("v0", "930, 931, 932, 933, 934, 935")) + f"SELECT Code, Date, {O.r('v', 'adjusted_vwap')} FROM v0")
def adjusted_vwap(spark, sf):
    return rounded(labels.adjusted_vwap(A.minute_bars(spark, sf), labels.LABELS["o2o"].exit_minutes))


def _register_label(protocol: str) -> None:
    @query(f"label_{protocol}", O.label_query(protocol))
    def run(spark, sf):
        return rounded(labels.build_labels(A.minute_bars(spark, sf), protocol))


for _protocol in R.PROTOCOLS:
    _register_label(_protocol)


@query("target_zscore", O.cte(O.DAILY, "t AS (SELECT Code, Date, close / pre_close - 1 AS raw FROM daily)") + f"SELECT Code, Date, {O.r('raw', 'raw')}, {O.r(O.ZSCORE.format(x='raw'), 'target')} FROM t")
def target_zscore(spark, sf):
    bars = stage(A.daily_bars(spark, sf).select("Code", "Date", change(F.col("close"), F.col("pre_close")).alias("raw")))
    return rounded(labels.zscore_by_date(bars, "raw", "target"))


# ---- calendar and universe ------------------------------------------------------------------------------------
@query("calendar_endpoints", O.cte(O.DAILY, O.CALENDAR.format(source="daily")) + "SELECT Date AS signal_date, entry_date, exit_date FROM days WHERE exit_date IS NOT NULL")
def calendar_endpoints(spark, sf):
    days = A.calendar_of(A.daily_bars(spark, sf))
    return C.map_endpoints(days, days)


def signal_dates(calendar: DataFrame) -> DataFrame:
    """All sessions but the last two, which lack endpoints."""
    return C.sessions(calendar).filter("exit_date IS NOT NULL").select("Date")


def daily_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """One row per session; the scan touches the ship date only."""
    return A.table(spark, sf, "lineitem").select(A._date_int(F.col("l_shipdate")).alias("Date")).distinct()


def roles_of(calendar: DataFrame) -> DataFrame:
    return C.date_roles(signal_dates(calendar), calendar, A.DERIVED_FOLDS)


@query("date_roles", O.cte(O.DAILY, O.CALENDAR.format(source="daily"), O.ROLES) + "SELECT fold_id, split, signal_date, entry_date, exit_date, purged FROM roles")
def date_roles(spark, sf):
    roles = stage(roles_of(stage(daily_calendar(spark, sf))))
    C.check_date_roles(roles)
    return roles


@query("dates_in_years", O.cte(O.DAILY) + "SELECT DISTINCT Date FROM daily WHERE Date // 10000 BETWEEN 1996 AND 1999")
def dates_in_years(spark, sf):
    return C.dates_in_years(daily_calendar(spark, sf), 1996, 1999)


@query("entry_eligibility", O.cte(O.DAILY, O.CALENDAR.format(source="daily"), *O.eligible_chain("daily")) + "SELECT Code, Date FROM eligible")
def entry_eligibility(spark, sf):
    bars = A.daily_bars(spark, sf)
    return eligible_keys(bars, stage(daily_calendar(spark, sf)))


def eligible_keys(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    mapping = C.sessions(calendar).filter("entry_date IS NOT NULL").select(F.col("Date").alias("signal_date"), "entry_date")
    return universe.entry_eligible_universe(universe.on_entry_dates(A.eligibility_of(bars), mapping), mapping)


@query("complete_history", O.cte(O.DAILY, O.CALENDAR.format(source="daily"), *O.history_chain("daily")) + "SELECT Code, Date FROM history")
def complete_history(spark, sf):
    return universe.complete_history_universe(A.daily_bars(spark, sf), daily_calendar(spark, sf))


def daily_model_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Model panel over five daily features; the label is the close return from entry to exit session."""
    bars = stage(A.daily_bars(spark, sf))
    calendar = stage(daily_calendar(spark, sf))
    adjusted = B.prepare_daily_panel(bars)
    feats = features.daily_features(adjusted, O.PANEL_FEATURES)
    feats = stage(feats.selectExpr("Code", "Date", *[f"CAST({n} AS FLOAT) AS {n}" for n in O.PANEL_FEATURES]))
    days = C.sessions(calendar).filter("exit_date IS NOT NULL").select(F.col("Date").alias("signal"), "entry_date", "exit_date")
    ahead = adjusted.selectExpr("Code", "Date AS entry_date", "close_adj", f"lead(struct(Date, close_adj)) {features.HISTORY} AS next")
    matched = ahead.join(F.broadcast(days), "entry_date").filter("next.Date = exit_date")  # one row per trading day
    outcome = change(F.col("next.close_adj"), F.col("close_adj")).cast("float").alias("raw_return")
    returns = matched.select("Code", F.col("signal").alias("Date"), outcome)
    return universe.prepare_model_panel(
        feats, returns, O.PANEL_FEATURES, "raw_return", "target", eligible_keys(bars, calendar),
        universe.complete_history_universe(feats, calendar, 3),
    )


@query("model_panel", O.cte(*O.panel_chain()) + f"SELECT Code, Date, {O.PANEL_COLUMNS} FROM panel")
def model_panel(spark, sf):
    return rounded(daily_model_panel(spark, sf), 5)


@query("split_samples", O.cte(*O.panel_chain(), O.ROLES, "act AS (SELECT * FROM roles WHERE NOT purged)") + """
SELECT a.fold_id, a.split, count(p.Code) AS n_rows, count(DISTINCT p.Date) AS n_dates, round(sum(target)::DOUBLE, 3) AS target_sum
FROM act a LEFT JOIN panel p ON a.signal_date = p.Date AND CASE WHEN a.split = 'test' THEN is_eligible ELSE is_eligible AND target IS NOT NULL END GROUP BY 1, 2""")
def split_samples(spark, sf):
    panel = stage(daily_model_panel(spark, sf))
    roles = stage(roles_of(stage(daily_calendar(spark, sf))))
    parts = None
    for fold in ("F1", "F2"):
        for split in C.SPLITS:
            rows = universe.split_samples(panel, roles, fold, split).agg(
                F.count(F.lit(1)).alias("n_rows"), F.countDistinct("Date").alias("n_dates"),
                F.sum(F.col("target").cast("double")).alias("target_sum"),
            )
            part = rounded(rows, 3).select(F.lit(fold).alias("fold_id"), F.lit(split).alias("split"), "*")
            parts = part if parts is None else parts.unionByName(part)
    return parts


_SEQUENCES = O.cte(O.DAILY, O.adjusted("daily"), O.lookback(), O.CALENDAR.format(source="daily"),
       "f AS (SELECT Code, Date, coalesce(" + O.D1["RET_OC"] + ", 0)::FLOAT AS a, coalesce(" + O.D1["CLOSE_VWAP"] + ", 0)::FLOAT AS b FROM look)", *O.history_chain("f")) + """
, w AS (SELECT Code, Date, first_value(a) OVER w AS oldest_ret, sum(a::DOUBLE) OVER w AS sum_ret, sum(b::DOUBLE) OVER w AS sum_dev, b AS last_dev FROM f
  WINDOW w AS (PARTITION BY Code ORDER BY Date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT Code, Date, 10 AS steps, round(oldest_ret::DOUBLE, 5) AS oldest_ret, round(sum_ret, 5) AS sum_ret, round(sum_dev, 5) AS sum_dev, round(last_dev::DOUBLE, 5) AS last_dev
FROM w JOIN history USING (Code, Date)"""


def sequence_report(windows: DataFrame) -> DataFrame:
    """What the twins of the sequence queries compare."""

    def column_sum(index: int) -> Column:
        values = F.transform("sequence", lambda step: step[index].cast("double"))
        return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)

    last = F.element_at("sequence", -1)
    return rounded(windows.select(
        "Code", "Date", F.size("sequence").alias("steps"), F.get(F.get("sequence", 0), 0).alias("oldest_ret"),
        column_sum(0).alias("sum_ret"), column_sum(1).alias("sum_dev"), F.get(last, 1).alias("last_dev"),
    ), 5)


SEQUENCE_FIELDS = ["D1_RET_OC", "D1_CLOSE_VWAP"]


@query("sequence_windows", _SEQUENCES)
def sequence_windows(spark, sf):
    panel = features.daily_features(adjusted_daily(spark, sf), SEQUENCE_FIELDS).fillna(0.0, SEQUENCE_FIELDS)
    return sequence_report(universe.sequence_windows(panel, SEQUENCE_FIELDS, daily_calendar(spark, sf)))


@query("stored_sequences", _SEQUENCES + " WHERE Date % 3 = 1")
def stored_sequences(spark, sf):
    """The same windows from a table stored by stock and session, for the marked rows only."""
    panel = features.daily_features(adjusted_daily(spark, sf), SEQUENCE_FIELDS).fillna(0.0, SEQUENCE_FIELDS)
    table = sequences.store_sessions(panel, SEQUENCE_FIELDS, daily_calendar(spark, sf))
    return sequence_report(sequences.stored_sequences(spark, table, F.col("Date") % 3 == 1))


# ---- predictions ----------------------------------------------------------------------------------------------
_MODELS = ", ".join(O.r(m, m) for m in O.MODELS)


@query("prediction_align", O.cte(*O.scores_chain()) + f"SELECT Code, Date, {_MODELS} FROM sw")
def prediction_align(spark, sf):
    panel = stage(score_panel(spark, sf))
    sources = {m: panel.select("Date", "Code", F.col(m).alias("prediction")) for m in SCORE_FIELDS}
    return rounded(with_int_date(predictions.align_model_predictions(sources)))


@query("attach_outcomes", O.cte(*O.scores_chain(), f"oc AS (SELECT Code, Date, ret FROM sw WHERE (CAST(Code AS INT) + Date) % 5 <> 0)") + f"SELECT Code, Date, {O.r('lgb', 'score')}, {O.r('oc.ret', 'raw_return')} FROM sw LEFT JOIN oc USING (Code, Date)")
def attach_outcomes(spark, sf):
    panel = stage(score_panel(spark, sf))
    outcomes = panel.filter((F.col("Code").cast("int") + F.col("Date")) % 5 != 0).select("Date", "Code", "raw_return")
    scores = panel.select("Date", "Code", F.col("lgb").alias("score"))
    return rounded(with_int_date(predictions.attach_outcomes(scores, outcomes, "raw_return")))


_DAILY_METRICS = O.cte(*O.scores_chain(), """
pp AS (SELECT model, Date, CASE WHEN ret IS NOT NULL THEN score END AS p, ret AS y FROM sl),
ma AS (SELECT *, avg(y) OVER (PARTITION BY model, Date) AS my FROM pp),
dm AS (SELECT model, Date, count(*) AS n_rows, count(p) AS n,
  CASE WHEN count(p) < 2 OR min(p) = max(p) OR min(y) = max(y) THEN 0 ELSE greatest(-1, least(1, covar_pop(p, y) / (stddev_pop(p) * stddev_pop(y)))) END AS ic,
  coalesce(avg((p - y) * (p - y)), 0) AS mse,
  CASE WHEN count(p) >= 2 AND sum((y - my) * (y - my)) > 0 THEN 1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)) ELSE 0 END AS r2 FROM ma GROUP BY model, Date)""")


@query("daily_ic", _DAILY_METRICS + f"SELECT model, Date, {O.r('ic', 'ic')}, {O.r('mse', 'mse')}, {O.r('r2', 'r2')}, n_rows FROM dm".replace(f"round((r2)::DOUBLE, {O.DP})", "round(r2::DOUBLE, 3)"))
def daily_ic(spark, sf):
    long = long_scores(score_panel(spark, sf))
    daily = metrics.daily_regression_metrics(long, "score", "raw_return", ("model", "Date"))
    return rounded(rounded(daily, 3, ["r2"]), DIGITS, ["ic", "mse"])


@query("regression_metrics", _DAILY_METRICS + "SELECT model, round(avg(ic), 6) AS DailyICMean, round(avg(mse), 6) AS DailyMSEMean, round(avg(r2), 2) AS DailyR2Mean, count(*) AS NumDates, sum(n_rows)::BIGINT AS NumRows FROM dm GROUP BY model")
def regression_metrics(spark, sf):
    long = long_scores(score_panel(spark, sf))
    summary = metrics.regression_metrics(long, "score", "raw_return", ["model"])
    return rounded(rounded(summary, 2, ["DailyR2Mean"]), DIGITS, ["DailyICMean", "DailyMSEMean"])


@query("daily_rank_ic", O.cte(*O.scores_chain(), *O.IC) + f"SELECT model, Date, {O.r('ic', 'ic')}, {O.r('rank_ic', 'rank_ic')} FROM icd")
def daily_rank_ic(spark, sf):
    return rounded(metrics.daily_predictive_metrics(stage(score_panel(spark, sf)), outcome="raw_return", keys=("Date",), models=list(SCORE_FIELDS)))


@query("predictive_summary", O.cte(*O.scores_chain(), *O.IC) + """SELECT CASE WHEN grouping(y) = 1 THEN '1995-2001' ELSE y::VARCHAR END AS period, model,
round(avg(ic), 6) AS ic, round(avg(rank_ic), 6) AS rank_ic FROM (SELECT *, Date // 10000 AS y FROM icd) GROUP BY GROUPING SETS ((model), (model, y))""")
def predictive_summary(spark, sf):
    daily = metrics.daily_predictive_metrics(stage(score_panel(spark, sf)), outcome="raw_return", keys=("Date",), models=list(SCORE_FIELDS))
    return rounded(portfolio.period_predictive_summary(daily, "1995-2001"))


@query("daily_spearman_matrix", O.cte(*O.scores_chain(), O.RANKED, """
c AS (SELECT model, Date, Code, rk - (n + 1) / 2.0::DOUBLE AS d FROM ranks),
pr AS (SELECT a.model AS model_a, b.model AS model_b, a.Date, sum(a.d * b.d) / sqrt(sum(a.d * a.d) * sum(b.d * b.d)) AS rho
       FROM c a JOIN c b ON a.Date = b.Date AND a.Code = b.Code GROUP BY 1, 2, 3)""") + "SELECT model_a, model_b, round(avg(rho), 6) AS correlation FROM pr GROUP BY 1, 2")
def daily_spearman_matrix(spark, sf):
    """Rank dependence is defined for dates with two stocks or more; others have no part in it."""
    return rounded(predictions.average_daily_spearman(cross_sections(score_panel(spark, sf)).drop("raw_return")))


@query("rank_zscore_ensemble", O.cte(*O.scores_chain(), O.RANKED, "zz AS (SELECT Date, Code, (rk - (n + 1) / 2.0::DOUBLE) / stddev_samp(rk) OVER (PARTITION BY model, Date) AS z FROM ranks)") + "SELECT Date, Code, round(avg(z), 6) AS ensemble_score FROM zz GROUP BY Date, Code")
def rank_zscore_ensemble(spark, sf):
    """Rank z-scores are defined for dates with two stocks or more; others have no part in it."""
    return rounded(predictions.rank_zscore_ensemble(cross_sections(score_panel(spark, sf))))


# ---- portfolios -----------------------------------------------------------------------------------------------
@query("select_top_quantile", O.cte(*O.grid_chain()) + f"SELECT model, Date, Code, {O.r('strength * CASE WHEN pos < 0 THEN -1 ELSE 1 END', 'score')}, pos::DOUBLE AS position FROM picked WHERE mode = 'signed' AND quantile = 0.25")
def select_top_quantile(spark, sf):
    long = long_scores(stage(score_panel(spark, sf))).select("model", "Date", "Code", "score")
    return rounded(portfolio.select_top_quantile(long, "signed", 0.25, ("model", "Date")))


def daily_grid(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.backtest_grid(stage(score_panel(spark, sf)), outcome="raw_return", keys=("Date",), models=list(SCORE_FIELDS))


@query("portfolio_grid", O.cte(*O.grid_chain()) + """SELECT model, Date, mode, quantile, round(pnl, 6) AS pnl, k::DOUBLE AS notional,
round(CASE WHEN k > 0 THEN pnl / k ELSE 0 END, 6) AS ppd, hits AS hit_count, moves AS hit_denominator, round(CASE WHEN moves > 0 THEN hits / moves::DOUBLE ELSE 0 END, 6) AS hit_ratio,
longs AS long_count, k AS position_count, round(CASE WHEN k > 0 THEN longs / k::DOUBLE ELSE 0 END, 6) AS long_share, k AS selected_count, obs AS observed_return_count, k - obs AS missing_return_count FROM grid""")
def portfolio_grid(spark, sf):
    return rounded(daily_grid(spark, sf))


@query("portfolio_summary", O.cte(*O.grid_chain()) + f"SELECT 'all' AS period, model, mode, quantile, {O.SUMMARY} FROM grid GROUP BY model, mode, quantile")
def portfolio_summary(spark, sf):
    return rounded(portfolio.portfolio_summary(daily_grid(spark, sf), "all"))


@query("annual_summary", O.cte(*O.grid_chain()) + f"SELECT CASE WHEN grouping(y) = 1 THEN '1995-2001' ELSE y::VARCHAR END AS period, model, mode, quantile, {O.SUMMARY} FROM (SELECT *, Date // 10000 AS y FROM grid) GROUP BY GROUPING SETS ((model, mode, quantile), (model, mode, quantile, y))")
def annual_summary(spark, sf):
    return rounded(portfolio.period_portfolio_summary(daily_grid(spark, sf), "1995-2001"))


@query("rolling_combine", O.cte(*O.grid_chain()) + f"SELECT model, mode, quantile, {O.SUMMARY} FROM grid WHERE Date // 10000 IN (2000, 2001) GROUP BY model, mode, quantile")
def rolling_combine(spark, sf):
    daily = stage(daily_grid(spark, sf))
    parts = [daily.filter(F.floor(F.col("Date") / 10000) == year) for year in (2000, 2001)]
    return rounded(portfolio.combine_rolling_years(*parts, years=(2000, 2001), by=("model", "mode", "quantile"))[1])


@query("flagship", O.cte(O.DAILY, O.adjusted("daily"), O.lookback(), f"sl AS (SELECT 'reversal' AS model, Code, Date, -({O.q(O.C, 'c5')}-1) AS score, {O.q(f'lead({O.C}) OVER (PARTITION BY Code ORDER BY Date)', O.C)} - 1 AS ret FROM look)", O.GRID_PARTS.format(src="sl")) + f"SELECT mode, quantile, {O.SUMMARY} FROM grid GROUP BY mode, quantile")
def flagship(spark, sf):
    """Ticks -> daily bars -> 5-row reversal score -> quantile portfolios -> summary."""
    base = features.daily_features(adjusted_daily(spark, sf), ["D1_RET_5D"], keep=["close_adj"])
    ahead = F.expr(f"lead(close_adj) {features.HISTORY}")
    panel = stage(base.select("Code", "Date", (-F.col("D1_RET_5D")).alias("score"), change(ahead, F.col("close_adj")).alias("return")))
    return rounded(portfolio.summarise_daily(portfolio.backtest_grid(panel, keys=("Date",)), ["mode", "quantile"]))


# ---- learning -------------------------------------------------------------------------------------------------
LEAF_L1, LEAF_L2 = 2.0, 1.0


@query("leaf_values", O.cte(*O.panel_chain(), "x AS (SELECT CASE WHEN coalesce(D1_RET_5D, 0) <= 0 THEN CASE WHEN coalesce(D1_CLOSE_VWAP, 0) <= 0 THEN 0 ELSE 1 END ELSE 2 END AS leaf, target::DOUBLE - 0.125 AS g FROM panel WHERE target IS NOT NULL)")
       + f"SELECT leaf, count(*) AS n, round(sum(g), 2) AS total, round(sign(sum(g)) * greatest(abs(sum(g)) - {LEAF_L1}, 0) / (count(*) + {LEAF_L2}), 5) AS value FROM x GROUP BY leaf")
def leaf_values(spark, sf):
    """Leaves of a given shape over the model panel, set anew from the residuals of a given start."""
    panel = daily_model_panel(spark, sf).filter("target IS NOT NULL")
    leaf = F.when(F.col("D1_RET_5D") <= 0, F.when(F.col("D1_CLOSE_VWAP") <= 0, 0).otherwise(1)).otherwise(2)
    found = learn.leaf_values(panel.withColumn("leaf", leaf), "leaf", F.col("target").cast("double") - 0.125, LEAF_L1, LEAF_L2)
    return rounded(rounded(found, 2, ["total"]), 5, ["value"])


def _fitted(spark: SparkSession, sf: str, fits: Sequence[tuple[str, str]]):
    """(preset, fold, model, history, samples) of each fit: five features, the preset's own trees, rounds and patience."""
    panel = stage(daily_model_panel(spark, sf))
    roles = stage(roles_of(stage(daily_calendar(spark, sf))))
    for preset, fold in fits:
        samples = {split: universe.split_samples(panel, roles, fold, split) for split in C.SPLITS}
        model, history = learn.train_on_panel(samples["train"], samples["validation"], O.PANEL_FEATURES, "target", preset)
        yield preset, fold, model, history, samples


@query("gbt_scores", None)
def gbt_scores(spark, sf):
    """Test scores of both folds, each by its own model."""
    parts = None
    for preset, fold, model, _, samples in _fitted(spark, sf, [("lgb", "F1"), ("lgb", "F2")]):
        scored = learn.predict(model, samples["test"], O.PANEL_FEATURES, "target", "raw_return")
        part = predictions.prediction_table(scored, preset, fold, "target", "raw_return")
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query("staged_ic_selection", None)
def staged_ic_selection(spark, sf):
    """The validation metrics of all rounds that were grown, and which of them the model keeps, for both presets."""
    parts = None
    for preset, _, model, history, _ in _fitted(spark, sf, [("lgb", "F1"), ("xgb", "F1")]):
        part = history.select(F.lit(preset).alias("model"), "*", (F.col("round") <= model.getNumTrees).alias("kept"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


CHAIN_YEARS = (2022, 2023, 2024)
CHAIN_MODELS = ("lgb", "xgb")


def run_chain(spark: SparkSession, sf: str, root: str) -> DataFrame:
    """All jobs in turn, each on what the ones before wrote under *root*: from bars to the portfolio summary."""
    minutes = A.short_sessions(spark, sf, CHAIN_YEARS)
    inputs = {"minutes": minutes, "daily": A.intraday_daily_bars(minutes)}
    for name, frame in inputs.items():
        frame.write.parquet(f"{root}/{name}")
    daily = spark.read.parquet(f"{root}/daily")
    A.calendar_of(daily).write.parquet(f"{root}/calendar")
    A.eligibility_of(daily).write.parquet(f"{root}/eligibility")
    days = C.sessions(spark.read.parquet(f"{root}/calendar"))
    days.filter("exit_date IS NOT NULL").select("Date").write.parquet(f"{root}/signals")
    jobs.build_features(spark, f"{root}/daily", f"{root}/minutes", f"{root}/features", "o2o", f"{root}/calendar")
    jobs.build_label_table(spark, f"{root}/minutes", f"{root}/labels", "o2o", f"{root}/calendar")
    folds = [C.Fold("F1", *[(year, year) for year in CHAIN_YEARS])]
    jobs.build_splits(spark, f"{root}/signals", f"{root}/calendar", f"{root}/roles.csv", folds, purge=1)
    jobs.prepare_panel(spark, f"{root}/features", f"{root}/labels", f"{root}/eligibility", f"{root}/calendar", f"{root}/roles.csv", f"{root}/panel", "o2o", length=3)
    for preset in CHAIN_MODELS:
        jobs.train(
            spark, f"{root}/panel", f"{root}/roles.csv", f"{root}/models", "o2o", "F1", preset, patience=3, block=3,
            maxIter=9, maxDepth=3, minInstancesPerNode=4, maxBins=16, stepSize=0.2,
        )
    jobs.backtest(spark, f"{root}/models/predictions", f"{root}/report", models=CHAIN_MODELS, label="2024")
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/report/portfolio_summary")


@query("whole_chain", None)
def whole_chain(spark, sf):
    """Bars, features, labels, splits, panel, two trained models, their scores and the backtest, job by job."""
    return run_chain(spark, sf, f"{shared_folder(spark).rstrip('/')}/chain-{uuid.uuid4().hex}")


@query("backtest_report", None)
def backtest_report(spark, sf):
    """The whole evaluation job: alignment, ensemble, grid, all periods, nine score columns."""
    panel = cross_sections(score_panel(spark, sf))  # the ensemble needs two stocks a date
    long = predictions.unpivot_predictions(panel)
    return jobs.evaluate(long, panel.select("Date", "Code", "raw_return"), label="1995-2001")["portfolio_summary"]
