import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.operators import groups as G
from panelwright.operators import metrics as M
from panelwright.operators import portfolio as P
from panelwright.operators import predictions as PR


def test_groups_are_whole_across_batches_and_missing_keys():
    table = pa.table({"m": ["a", "a", "a", "b", "b", None, None], "d": [1, 1, 2, 2, 2, 2, 2], "v": [0.0, 1, 2, 3, 4, 5, 6]})
    batches = [table.slice(i, 2).to_batches()[0] for i in range(0, 6, 2)] + [table.slice(6, 1).to_batches()[0]]
    parts = list(G.whole_groups(iter(batches), ["m", "d"]))
    edges = [[part.column("v")[int(a)].as_py() for a in G.group_edges(part, ["m", "d"])[:-1]] for part in parts]
    assert sum(edges, []) == [0.0, 2.0, 3.0, 5.0] and sum(part.num_rows for part in parts) == 7
    assert G.average_ranks(np.array([3.0, 1.0, 3.0, 2.0])).tolist() == [3.5, 1.0, 3.5, 2.0]


def test_grid_of_small_groups_takes_no_window(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(d, f"{i:03d}", "m", float(np.round(rng.normal(), 1)), None if i % 7 == 0 else float(np.round(rng.normal(), 2))) for d in range(3) for i in range(40)]
    rows += [(9, "000", "m", 0.0, 1.0), (9, "001", "m", float("nan"), float("inf")), (9, "002", "m", None, 1.0)]
    panel = spark.createDataFrame(rows, "Date int, Code string, model string, score double, return double")
    grid, daily = P.backtest_grid(panel), M.daily_predictive_metrics(panel)
    for frame in (grid, daily):
        assert "Window" not in frame._jdf.queryExecution().optimizedPlan().toString()
    frames = [grid.orderBy("Date", "mode", "quantile").toPandas(), daily.orderBy("Date").toPandas()]
    monkeypatch.setattr(G, "WINDOW_ROWS", 10)
    others = [P.backtest_grid(panel).orderBy("Date", "mode", "quantile").toPandas(), M.daily_predictive_metrics(panel).orderBy("Date").toPandas()]
    for left, right in zip(frames, others):
        pd.testing.assert_frame_equal(left, right[left.columns], check_exact=False, rtol=1e-9)
    monkeypatch.undo()
    with pytest.raises(Exception, match="repeat a key"):
        P.backtest_grid(panel.unionByName(panel.limit(1))).collect()


def test_models_share_one_exchange_and_rows_stay_wide(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(d, f"{i:03d}", *np.round(rng.normal(size=3), 1).tolist(), None if i % 7 == 0 else float(np.round(rng.normal(), 2))) for d in range(4) for i in range(30 + d)]
    rng.shuffle(rows)
    wide = spark.createDataFrame([(int(r[0]), str(r[1]), *[None if v is None else float(v) for v in r[2:]]) for r in rows], "Date int, Code string, a double, b double, c double, return double")
    models, order = ["a", "b", "c"], ["model", "Date"]
    long = wide.unpivot(["Date", "Code", "return"], models, "model", "score")

    def everything():
        return [
            PR.average_daily_spearman(wide, models), PR.rank_zscore_ensemble(wide, models),
            P.backtest_grid(wide, keys=("Date",), models=models), M.daily_predictive_metrics(wide, keys=("Date",), models=models),
        ]

    sorts = [["model_a", "model_b"], ["Date", "Code"], [*order, "mode", "quantile"], order]
    frames = everything()
    for frame in frames:
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Expand" not in plan and plan.count("RepartitionByExpression") == 1
    small = [frame.orderBy(by).toPandas() for frame, by in zip(frames, sorts)]
    other = [P.backtest_grid(long).orderBy(sorts[2]).toPandas(), M.daily_predictive_metrics(long).orderBy(order).toPandas()]
    monkeypatch.setattr(G, "WINDOW_ROWS", 10)
    for left, right in zip([*small, *small[2:]], [*[frame.orderBy(by).toPandas() for frame, by in zip(everything(), sorts)], *other]):
        pd.testing.assert_frame_equal(left, right[left.columns], check_exact=False, rtol=1e-9)
    monkeypatch.undo()
    with pytest.raises(Exception, match="repeats a key"):
        PR.average_daily_spearman(wide.unionByName(wide.limit(1)), models).collect()


def test_outcomes_meet_the_predictions_in_one_aggregate(spark):
    models = ["a", "b"]
    wide = spark.createDataFrame([(20240102, "1", 1.0, 2.0), (20240102, "2", 3.0, 4.0), (20240103, "1", 5.0, 6.0)], "Date int, Code string, a double, b double")
    outcomes = spark.createDataFrame([("2024-01-02", "1", 0.5), ("2024-01-03", "1", float("inf")), ("2024-01-04", "9", 0.1)], "Date string, Code string, ret double")
    long = PR.unpivot_predictions(wide, models)
    got = PR.align_predictions(long, models, outcomes, "ret")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = PR.attach_outcomes(PR.align_predictions(long, models), outcomes, "ret")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())) and got.count() == 3
    with pytest.raises(Exception, match="duplicate outcome keys"):
        PR.align_predictions(long, models, outcomes.unionByName(outcomes.filter("Code = '9'")), "ret").collect()
    with pytest.raises(Exception, match="do not match"):
        PR.align_predictions(long.filter("model = 'a' OR Code <> '000002'"), models, outcomes, "ret").collect()
    with pytest.raises(Exception, match="finite"):
        PR.unpivot_predictions(wide.withColumn("b", F.lit(float("nan"))), models).collect()
