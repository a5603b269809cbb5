import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import groups as G
from panelwright.operators import metrics as M
from panelwright.operators import portfolio as P
from panelwright.operators import predictions as PR
from panelwright.registry import EIGHT_MODELS


def test_daily_metrics_weigh_dates_equally(frame):
    labels, scores = [1.0, 2.0, 3.0] * 2, [1.0, 2.0, 3.0, 5.0, 5.0, 5.0]
    rows = frame([(1 + i // 3, s, y) for i, (s, y) in enumerate(zip(scores, labels))], "Date int, prediction double, target double")
    row = M.regression_metrics(rows).first()
    assert row.DailyICMean == pytest.approx(0.5) and row.DailyMSEMean == pytest.approx(29 / 6)
    assert row.DailyR2Mean == pytest.approx(-6.25) and (row.NumDates, row.NumRows) == (2, 6)


def test_tiny_scores_keep_their_correlation(frame):
    rows = [(1, s * 1e-200, y) for s, y in ((1, 1.0), (2, 2.0), (3, 3.0))] + [(2, 1.0, y) for y in (1.0, 2.0)] + [(3, 1.0, 1.0), (4, None, 1.0)]
    got = M.daily_regression_metrics(frame(rows, "Date int, p double, y double"), "p", "y").orderBy("Date").collect()
    assert [r.ic for r in got] == pytest.approx([1.0, 0.0, 0.0, 0.0]) and got[3].mse == 0.0


def panel(frame, rows):
    return frame(rows, "Date int, Code string, score double, return double")


def test_quantile_counts_and_ties(frame):
    day = panel(frame, [(1, c, float(i + 1), 0.0) for i, c in enumerate("EDCBA")])
    for quantile, count in ((1.0, 5), (0.75, 4), (0.5, 3), (0.25, 2)):
        assert P.select_top_quantile(day, "signed", quantile).count() == count
    ties = panel(frame, [(1, "B", 2.0, 5.0), (1, "A", 2.0, None), (1, "C", -3.0, -1.0), (1, "D", 0.0, 999.0)])
    assert {r.Code: r.position for r in P.select_top_quantile(ties, "signed", 0.5).collect()} == {"C": -1.0, "A": 1.0}
    signed = P.backtest_daily(ties, "signed", 0.5).first()
    assert (signed.pnl, signed.notional, signed.ppd, signed.missing_return_count, signed.hit_ratio, signed.long_share) == (1.0, 2.0, 0.5, 1, 1.0, 0.5)
    only = P.backtest_daily(ties, "long_only", 0.5).first()
    assert (only.pnl, only.notional, only.missing_return_count, only.hit_ratio, only.long_share) == (0.0, 1.0, 1, 0.0, 1.0)
    with pytest.raises(ValueError):
        P.select_top_quantile(ties, "signed", 0.3)
    idle = P.backtest_daily(panel(frame, [(1, "A", 0.0, 1.0), (2, "A", -1.0, 1.0)]), "long_only", 1.0)
    assert idle.count() == 2 and idle.agg(F.sum("selected_count")).first()[0] == 0


def test_rolling_years_recompute(frame):
    rows = panel(frame, [(20240102, "A", 1.0, 1.0), (20240103, "A", 1.0, 3.0), (20250102, "A", 1.0, -1.0), (20250102, "B", 1.0, -1.0), (20250103, "A", 1.0, 1.0), (20250103, "B", 1.0, 0.0)])
    daily = P.backtest_daily(rows, "long_only", 1.0)
    first, second = daily.filter("Date < 20250101"), daily.filter("Date > 20250101")
    combined, summary = P.combine_rolling_years(first, second)
    assert [r.pnl for r in combined.orderBy("Date").collect()] == [1.0, 3.0, -2.0, 1.0]
    row = summary.first()
    pnl = [1.0, 3.0, -2.0, 1.0]
    assert (row.pnl, row.notional, row.ppd, row.long_share) == (3.0, 6.0, 0.5, 1.0)
    assert row.hit_ratio == pytest.approx(3 / 5)
    assert row.sharpe_ratio == pytest.approx(np.sqrt(252) * np.mean(pnl) / np.std(pnl, ddof=1))
    with pytest.raises(ValueError, match="expected only 2024"):
        P.combine_rolling_years(daily, second)


def sources(frame, keys):
    return {
        model: frame([(d, c, float(i) + k / 100) for i, (d, c) in enumerate(keys)], "Date string, Code string, prediction double")
        for k, model in enumerate(EIGHT_MODELS)
    }


def test_alignment_and_outcomes(frame):
    keys = [("2024-01-02", "2"), ("2024-01-02", "000001"), ("2024-01-03", "000001")]
    wide = PR.align_model_predictions(sources(frame, keys))
    assert wide.columns == ["Date", "Code", *EIGHT_MODELS] and wide.count() == 3
    assert [r.Code for r in wide.orderBy("Date", "Code").collect()] == ["000001", "000002", "000001"]
    short = sources(frame, keys)
    short["mamba"] = short["mamba"].filter("Date = '2024-01-02'")
    with pytest.raises(Exception, match="do not match"):
        PR.align_model_predictions(short).collect()
    with pytest.raises(Exception, match="do not match"):  # also where the offending model is not selected
        PR.align_model_predictions(short).select("Date", "gru").collect()
    assert [tuple(r) for r in PR.alignment_counts(PR.stack_predictions(short)).collect()] == [("mamba", 1, 0)]
    outcomes = frame([("2024-01-02", "1", 0.1), ("2024-01-03", "1", float("inf"))], "Date string, Code string, return double")
    attached = PR.attach_outcomes(wide, outcomes)
    assert attached.count() == 3 and attached.filter("return IS NULL").count() == 2
    with pytest.raises(ValueError, match="registered models"):
        PR.stack_predictions({"lgb": short["lgb"]})


def test_spearman_and_ensemble(spark):
    rows = []
    for day, count in ((20240102, 3), (20250102, 5)):
        for i in range(count):
            up = 1.0 if day < 20250101 and i < 2 else float(i + 1)
            scores = {m: up for m in EIGHT_MODELS} | ({"xgb": float(count - i)} if day > 20250101 else {})
            rows.append({"Date": day, "Code": f"{i:06d}", **scores})
    wide = spark.createDataFrame(pd.DataFrame(rows))
    matrix = {(r.model_a, r.model_b): r.correlation for r in PR.average_daily_spearman(wide).collect()}
    assert matrix["lgb", "xgb"] == pytest.approx(0.0, abs=1e-12) and matrix["mlp", "lgb"] == pytest.approx(1.0)
    scores = PR.rank_zscore_ensemble(wide).orderBy("Date", "Code").toPandas()["ensemble_score"].to_numpy()
    ranks = pd.Series([1.5, 1.5, 3.0])
    assert scores[:3] == pytest.approx(((ranks - ranks.mean()) / ranks.std()).to_numpy())
    base = pd.Series(np.arange(1.0, 6.0))
    assert scores[3:] == pytest.approx((0.75 * (base - base.mean()) / base.std()).to_numpy())
    flat = wide.withColumn("kan", F.lit(1.0))
    with pytest.raises(Exception, match="constant"):
        PR.rank_zscore_ensemble(flat).collect()


def hot_panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for day, count in ((1, 600), (2, 60), (3, 9)):
        score = np.round(rng.normal(size=count), 1)  # heavy ties
        rows += [(day, f"{i:06d}", "m", float(score[i]), None if rng.random() < 0.1 else float(rng.normal())) for i in range(count)]
    return spark.createDataFrame(rows, "Date int, Code string, model string, score double, return double")


def test_hot_groups_give_the_same_results(spark, monkeypatch):
    rows = hot_panel(spark)

    def everything():
        parts = [
            P.backtest_grid(rows).orderBy("Date", "mode", "quantile").toPandas(),
            M.daily_predictive_metrics(rows).orderBy("Date").toPandas(),
            M.daily_regression_metrics(rows, "score", "return").orderBy("Date").toPandas(),
            G.average_rank(rows, ["Date"], "score", "rank").orderBy("Date", "Code").select("Date", "Code", "rank").toPandas(),
            PR.rank_zscore_ensemble(rows.withColumnRenamed("score", "a"), ["a"]).orderBy("Date", "Code").toPandas(),
        ]
        return parts

    plain = everything()
    monkeypatch.setattr(G, "WINDOW_ROWS", 50)
    monkeypatch.setattr(G, "SAMPLE_ROWS", 64)
    for left, right in zip(plain, everything()):
        pd.testing.assert_frame_equal(left, right[left.columns], check_exact=False, rtol=1e-9)
    expected = rows.toPandas().groupby("Date")["score"].rank(method="average")
    assert sorted(plain[3]["rank"]) == sorted(expected)
