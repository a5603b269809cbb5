from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from panelwright import registry as R
from panelwright.operators import bars as B
from panelwright.operators import features as FE
from panelwright.operators import normalize as N

SLOT_ENDS = (930, 1000, 1001, 1030, 1031, 1100, 1101, 1130, 1301, 1330, 1331, 1400, 1401, 1430, 1431, 1500)
CODES = ("000001.SZ", "600000.SH")


def business_days(count, start=date(2024, 1, 2)):
    days, day = [], start
    while len(days) < count:
        if day.weekday() < 5:
            days.append(int(day.strftime("%Y%m%d")))
        day += timedelta(days=1)
    return days


def daily_rows(days):
    rows = []
    for i, code in enumerate(CODES):
        previous = 10.0 + i
        for k, day in enumerate(days):
            close = 10.0 + i + k * 0.01
            rows.append((code, day, close - 0.02, close + 0.05, close - 0.05, close, previous, 1000.0 + k, close * (1000.0 + k) / 10, 1.0, close))
            previous = close
    return rows


DAILY = "code string, date int, open double, high double, low double, close double, pre_close double, vol double, amount double, adj_factor double, vwap double"
MINUTE = "code string, Date int, minute int, open double, high double, low double, close double, vol double, amount double, adj_factor double"


def minute_rows(day, minutes, shift=0.0):
    rows = []
    for i, code in enumerate(CODES):
        for k, minute in enumerate(minutes):
            price, volume = 10.5 + i + shift + k * 0.001, 100.0 + k
            rows.append((code, day, minute, price - 0.01, price + 0.02, price - 0.02, price, volume, price * volume, 1.0))
    return rows


@pytest.fixture(scope="module")
def panels(spark):
    days = business_days(66)
    daily = spark.createDataFrame(daily_rows(days[:65]), DAILY)
    signal, entry = days[64], days[65]
    minutes = spark.createDataFrame(
        minute_rows(signal, SLOT_ENDS) + minute_rows(days[63], SLOT_ENDS, 0.5) + minute_rows(entry, (930, 931), 0.1), MINUTE
    )
    calendar = spark.createDataFrame([(d,) for d in days], "Date int")
    de = FE.raw_feature_panel(daily, minutes, "de", calendar)
    return {"days": days, "de": de, "rows": de.toPandas(), "daily": daily, "minutes": minutes, "calendar": calendar}


def test_column_contracts_and_types(panels):
    assert (len(R.HALF_HOUR_COLUMNS), len(R.DAILY_COLUMNS), len(R.EARLY_OPEN_COLUMNS)) == (560, 39, 58)
    assert (len(R.raw_columns("o2o")), len(R.raw_columns("de"))) == (599, 657)
    assert panels["de"].columns == ["Code", "Date", *R.raw_columns("de")]
    assert {kind for name, kind in panels["de"].dtypes if name not in ("Code", "Date")} == {"float"}
    o2o = FE.raw_feature_panel(panels["daily"], panels["minutes"], "o2o")
    assert o2o.columns == ["Code", "Date", *R.raw_columns("o2o")]


def test_feature_values(panels):
    signal = panels["days"][64]
    assert len(panels["rows"]) == 4  # two codes on two dates with minute and daily bars
    row = panels["rows"].query("Code == '000001' and Date == @signal").iloc[0]
    close, first, last = 10.64, 10.5, 10.501
    assert row["M30_OPEN_1"] == pytest.approx((first - 0.01) / close, rel=1e-6)
    assert row["M30_RET_OC_1"] == pytest.approx(last / (first - 0.01) - 1, rel=1e-4)
    assert row["M30_RET_CC_1"] == pytest.approx(last / (close - 0.01) - 1, rel=1e-4)
    assert row["M30_RET_CC_2"] == pytest.approx((first + 0.003) / last - 1, rel=1e-3)
    assert row["M30_REALIZED_VOL_1"] == pytest.approx(last / first - 1, rel=1e-3)
    assert np.isnan(row["M30_MIN_RET_STD_1"]) and np.isnan(row["M30_RET_VOL_CORR_1"])
    assert row["M30_PRICEDEV_VOL_CORR_1"] == pytest.approx(1.0)
    assert row["M30_UP_MIN_RATIO_1"] == 1.0
    assert row["M30_VOL_SHARE_1"] == pytest.approx((100 + 101) / 106400, rel=1e-6)
    assert row["D1_RET_60D"] == pytest.approx(10.64 / 10.04 - 1, rel=1e-5)
    assert row["D1_MA_DEV_60D"] == pytest.approx(10.64 / np.mean([10.0 + 0.01 * k for k in range(5, 65)]) - 1, rel=1e-4)
    assert row["D1_CLOSE_POS_20D"] == pytest.approx((10.64 - 10.40) / (10.69 - 10.40), rel=1e-4)
    assert row["EO_AUCTION_RET_PREV_CLOSE"] == pytest.approx(10.6 / close - 1, rel=1e-4)
    earlier = panels["rows"].query("Code == '000001' and Date != @signal").iloc[0]
    # 930/931 bars of the next session exist only for the signal date (the session after holds 930, 1000 ...).
    assert earlier["EO_OPEN"] == pytest.approx(10.49 / 10.63, rel=1e-5)


def test_many_dates_equal_one_date(panels, spark):
    signal = panels["days"][64]
    one = FE.raw_feature_panel(panels["daily"], panels["minutes"].filter(f"Date >= {signal}"), "de", panels["calendar"]).toPandas()
    many = panels["rows"].query("Date == @signal")
    pd.testing.assert_frame_equal(
        one.sort_values("Code").reset_index(drop=True), many.sort_values("Code").reset_index(drop=True)
    )


def test_bar_rules_for_missing_values(spark):
    rows = [
        ("000001", 20240102, 930, None, 10.0, 9.0, 9.5, 100.0, 950.0),
        ("000001", 20240102, 931, 9.6, None, 9.1, None, None, None),
        ("000001", 20240102, 932, 9.7, 9.9, 9.2, 0.0, 50.0, 480.0),
        ("000001", 20240102, 933, 9.8, 9.9, 9.2, 9.0, 50.0, 480.0),
    ]
    schema = "Code string, Date int, Minute int, open double, high double, low double, close double, vol double, amount_adj double"
    bar = B.slot_bars(spark.createDataFrame(rows, schema)).toPandas().iloc[0]
    assert (bar.OPEN, bar.CLOSE, bar.HIGH, bar.LOW) == (9.6, 9.0, 10.0, 9.0)
    assert (bar.VOLUME, bar.AMOUNT, bar.VOLUME_FIRST, bar.VOLUME_LAST) == (200.0, 1910.0, 100.0, 50.0)
    assert bar.RET_N == 1 and np.isinf(bar.RET_MAX)  # only 0 -> 9 has both closes: +inf
    assert bar.UP_N == 1 and bar.UP_VOL == 50.0


def test_vwap_column_is_replaced_only_when_entirely_missing(spark):
    rows = [("000001", 20240102, 1.0, 1.0, 1.0, 1.0, 1.0, 10.0, 2.0, None), ("000002", 20240102, 1.0, 1.0, 1.0, 1.0, 1.0, 10.0, 2.0, None)]
    schema = "Code string, Date int, open double, high double, low double, close double, pre_close double, vol double, amount double, vwap double"
    empty = spark.createDataFrame(rows, schema)
    assert [r.vwap_adj for r in B.prepare_daily_panel(empty).collect()] == [2.0, 2.0]
    partly = spark.createDataFrame([rows[0][:-1] + (5.0,), rows[1]], schema)
    got = {r.Code: r.vwap_adj for r in B.prepare_daily_panel(partly).collect()}
    assert got == {"000001": 5.0, "000002": None}


def test_manifests():
    o2o, de = R.manifest_of("o2o"), R.manifest_of("de")
    R.check_manifest_pair(o2o, de)
    assert (len(o2o.columns), len(de.columns)) == (560, 602)
    assert o2o.columns[0] == "M30_OPEN_1_mad3_zscore" and de.columns[-1] == "EO_AUCTION_PRICE_DEV_VWAP_mad3_zscore"
    with pytest.raises(ValueError):
        R.manifest_of("o2o", o2o.columns[:-1])
    with pytest.raises(ValueError):
        R.check_manifest_pair(de, o2o)


def test_projection_order_and_missing_columns(spark):
    names = list(R.manifest_of("o2o").columns)
    text = ", ".join(f"CAST({i} AS FLOAT) AS {name}" for i, name in reversed(list(enumerate(names))))
    source = spark.sql(f"SELECT 20240102 AS Date, '000001' AS Code, 9 AS other, {text}")
    projected = FE.project_protocol_features(source, "o2o")
    assert projected.columns == ["Code", "Date", *names]
    assert projected.first()[3] == 1.0
    with pytest.raises(ValueError, match="missing"):
        FE.project_protocol_features(source.drop(names[5]), "o2o")


def test_normalisation_divides_by_all_rows(spark):
    rows = [("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, 3.0), ("d", 1, None)]
    z = N.mad_zscore(spark.createDataFrame(rows, "Code string, Date int, D1_X float"), min_valid=2).orderBy("Code").collect()
    scale = np.sqrt(2.0 / 3.0)
    assert [r.D1_X_mad3_zscore for r in z] == pytest.approx([-1 / scale, 0.0, 1 / scale, 0.0], rel=1e-6)


def test_normalisation_of_large_dates_is_identical(spark):
    rng = np.random.default_rng(5)
    rows = []
    for day, count in ((1, 400), (2, 40), (3, 7)):
        wild, ties = rng.normal(size=count) * 10.0 ** rng.integers(-8, 8, count), np.round(rng.normal(size=count))
        rows += [(f"{i:06d}", day, None if rng.random() < 0.1 else float(wild[i]), float(ties[i]), 1.0) for i in range(count)]
    data = spark.createDataFrame(rows, "Code string, Date int, D1_A float, D1_B float, D1_C float")
    frames = [
        N.mad_zscore(data, block_cells=cells).toPandas().sort_values(["Date", "Code"]).reset_index(drop=True)
        for cells in (N.BLOCK_CELLS, 150)
    ]
    for name in frames[0].columns[2:]:
        np.testing.assert_allclose(frames[0][name], frames[1][name], rtol=1e-6, atol=1e-7)
    assert (frames[0]["D1_C_mad3_zscore"] == 0).all() and not frames[0].isna().any().any()
