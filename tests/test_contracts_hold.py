"""Contracts fail the job whatever columns are asked for."""

import pytest
from pyspark.sql import functions as F

from panelwright.operators import calendar as C
from panelwright.operators import contracts, features, portfolio, predictions, universe

SCORES = "model string, Date int, Code string, score double, return double"
GOOD = [("m", 20240102, "000001", 1.0, 0.1), ("m", 20240102, "000002", -2.0, 0.2), ("m", 20240103, "000001", 0.5, None)]
BAD_SCORES = {"repeat": GOOD + [GOOD[1][:3] + (9.0, 0.0)], "lacks a key": GOOD + [("m", None, "000009", 1.0, 0.0)], "lacks a key ": GOOD + [("m", 20240102, "", 1.0, 0.0)]}
DAILY = "model string, Date int, pnl double, notional double, hit_count long, hit_denominator long, long_count long, position_count long, selected_count long"
DAY = ("m", 20240102, 0.5, 2.0, 1, 2, 1, 2, 2)
MODELS = ["a", "b"]


def fails(make, message, column):
    """Some checks run while the frame is made, others when its rows are."""
    with pytest.raises(Exception, match=message.strip()):
        make().select(column).collect()


@pytest.mark.parametrize("message", BAD_SCORES)
def test_score_panels(frame, message, monkeypatch):
    bad = frame(BAD_SCORES[message], SCORES)
    fails(lambda: portfolio.backtest_grid(bad), message, "quantile")
    fails(lambda: portfolio.select_top_quantile(bad, "signed", 1.0, ("model", "Date")), message, "model")
    assert portfolio.backtest_grid(frame(GOOD, SCORES)).count() == 16
    monkeypatch.setattr("panelwright.operators.groups.WINDOW_ROWS", 1)
    with pytest.raises(Exception, match=message.strip()):
        portfolio.backtest_grid(bad).select("quantile").collect()


def test_daily_tables(frame):
    for rows, message in (
        ([DAY, DAY], "one row a date"), ([DAY, ("m", 20240103, float("nan"), *DAY[3:])], "not finite"),
        ([DAY, ("m", 20240103, None, *DAY[3:])], "not finite"), ([DAY, ("m", None, *DAY[2:])], "one row a date"),
    ):
        bad = frame(rows, DAILY)
        fails(lambda: portfolio.summarise_daily(bad, ["model"]), message, "cash_days")
        fails(lambda: portfolio.summarise_daily(bad), message, "n_days")
    fails(lambda: portfolio.summarise_daily(frame([], DAILY)), "no daily rows", "cash_days")
    assert portfolio.summarise_daily(frame([DAY], DAILY), ["model"]).first().n_days == 1
    bad = frame([DAY + ("signed", 1.0), DAY + ("signed", 1.0)], DAILY + ", mode string, quantile double")
    fails(lambda: portfolio.period_portfolio_summary(bad, "all"), "one row a date", "period")


def test_wide_panels(frame):
    wide = "Date int, Code string, a double, b double"
    rows = [(20240102, "000001", 1.0, 4.0), (20240102, "000002", 2.0, 3.0), (20240102, "000003", 3.0, 5.0)]
    for extra, message in (
        (rows[0], "repeats a key"), ((20240102, None, 1.0, 2.0), "lacks a key"), ((None, "000007", 1.0, 2.0), "lacks a key"),
        ((20240102, "000007", float("inf"), 2.0), "not finite"), ((20240102, "000007", 1.0, None), "not finite"),
    ):
        bad = frame([*rows, extra], wide)
        fails(lambda: predictions.rank_zscore_ensemble(bad, MODELS), message, "Date")
        fails(lambda: predictions.average_daily_spearman(bad, MODELS), message, "model_a")
    assert predictions.rank_zscore_ensemble(frame(rows, wide), MODELS).count() == 3


def test_prediction_tables(frame):
    rows = [("20240102", "1", 0.5)]
    kinds = "Date string, Code string, prediction double"
    for extra, message in ((("20240199", "2", 0.1), "invalid"), (("20240102", "", 0.1), "invalid"), (("20240102", "3", float("nan")), "finite")):
        fails(lambda: predictions.read_prediction(frame([*rows, extra], kinds)), message, "Date")
    assert predictions.read_prediction(frame(rows, kinds)).count() == 1


def test_daily_bars_with_repeated_days(frame):
    names = ("open_adj", "high_adj", "low_adj", "close_adj", "pre_close_adj", "vwap_adj", "volume_shares", "amount_adj")
    kinds = "Code string, Date int, " + ", ".join(f"{n} double" for n in names)
    rows = [("000001", d, *[1.0 + d % 7] * 8) for d in (20240102, 20240103)]
    bad = frame([*rows, rows[1]], kinds)
    fails(lambda: features.daily_features(bad, ["D1_RET_OC"]), "repeat a", "Code")
    fails(lambda: features._reference(bad), "repeat a", "Date")
    assert features.daily_features(frame(rows, kinds), ["D1_RET_OC"]).count() == 2


def test_roles_and_mappings(frame):
    days = frame([(20240102 + i,) for i in range(6)], "Date int")
    folds = (C.Fold("F", (2023, 2023), (2024, 2024), (2025, 2025)),)
    fails(lambda: C.date_roles(days, days, folds, 1), "calendar endpoints", "fold_id")
    assert C.date_roles(days.filter("Date < 20240106"), days, folds, 1).select("fold_id").count() == 4
    panel = frame([("000001", 20240103, False, False, False)], "Code string, Date int, is_st boolean, is_limit_up_open boolean, is_limit_down_open boolean")
    mapping = frame([(20240103, 20240102), (20240103, 20240101)], "entry_date int, signal_date int")
    fails(lambda: universe.entry_eligible_universe(panel, mapping), "more than one signal date", "Code")
    assert universe.entry_eligible_universe(panel, mapping.limit(1)).count() == 1


def test_staged_counts_where_rows_are_written(spark, frame):
    left, right = frame([(1,), (2,), (3,)], "k int"), frame([(1, 1.0), (2, None)], "k int, v double")
    joined = left.join(right, "k", "left")
    assert contracts.staged(joined, {"keys": F.col("k").isNotNull()}, {"some value": F.col("v").isNotNull()}).count() == 3
    with pytest.raises(contracts.ContractError, match=r"values \(2 rows\)"):
        contracts.staged(joined, {"values": F.col("v").isNotNull()})
    with pytest.raises(contracts.ContractError, match="any row"):
        contracts.staged(joined.filter("k > 5"), some={"any row": F.col("k").isNotNull()})
    with pytest.raises(contracts.ContractError, match="any row"):
        contracts.staged(spark.createDataFrame([], "k int"), some={"any row": F.col("k").isNotNull()})


def test_report(frame):
    rows = [("a", 1, 1.0), ("a", 1, None), (None, 2, 3.0), ("b", 2, float("inf")), ("c", 3, 1.0)]
    bad = frame(rows, "Code string, Date int, v double")
    report = {(r.frame, r.rule): (r.n_keys, r.n_rows) for r in contracts.contract_report({"x": (bad, ("Code", "Date"), ("v",)), "y": (bad.limit(0), ("Code",), ())}).collect()}
    assert report == {("x", "null_key"): (1, 1), ("x", "duplicate_key"): (1, 2), ("x", "non_finite"): (2, 2)}
