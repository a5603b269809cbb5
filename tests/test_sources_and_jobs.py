import numpy as np
import pytest

from panelwright.operators import learn
from panelwright.operators import portfolio as P
from panelwright.plans import jobs
from panelwright.registry import EIGHT_MODELS
from panelwright.sources import tables as S


def test_dated_and_minute_directories(spark, tmp_path):
    bars = spark.createDataFrame([("000001", 1.5)], "Code string, close double")
    for stem in ("20240102", "20240103", "notes"):
        bars.coalesce(1).toPandas().to_parquet(tmp_path / f"{stem}.parquet")
    everything = S.read_dated_directory(spark, str(tmp_path))
    assert {r.Date for r in everything.collect()} == {"20240102", "20240103", "notes"}
    dated = S.read_dated_files(spark, str(tmp_path), first=20240103)
    assert [(r.Code, r.Date) for r in dated.collect()] == [("000001", 20240103)]
    assert {r.Date for r in S.list_dated_files(spark, str(tmp_path)).collect()} == {20240102, 20240103}
    minutes = S.read_minute_sessions(spark, str(tmp_path))
    assert "Minute" in minutes.columns and minutes.count() == 3


def test_text_tables_keep_leading_zeros(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Code,Date,x\n000001,20240102,1.5\n")
    (tmp_path / "a.tsv").write_text("Code\tDate\tx\n000001\t20240102\t1.5\n")
    for name in ("a.csv", "a.tsv"):
        row = S.read_frame(spark, str(tmp_path / name)).first()
        assert (row.Code, row.Date, row.x) == ("000001", 20240102, 1.5)
    with pytest.raises(ValueError, match="unsupported"):
        S.read_frame(spark, str(tmp_path / "a.xlsx"))


def test_projection_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("1.SZ", 20240102, 1.25)], "Code string, Date int, factor double")
    path = S.write_parquet(frame, str(tmp_path / "p.parquet"))
    assert S.read_parquet(spark, path, ["Date", "factor"]).columns == ["Date", "factor"]
    assert S.read_parquet(spark, path, normalize=True).first().Code == "000001"
    with pytest.raises(ValueError, match="missing"):
        S.read_parquet(spark, path, ["nope"])
    assert S.read_many_parquet(spark, [], ["a", "b"]).columns == ["a", "b"]
    assert S.read_many_parquet(spark, [path, path], ["Code"]).count() == 2


def test_splits_job_and_active_dates(spark, tmp_path):
    signals = [y * 10000 + 100 + d for y in range(2016, 2026) for d in range(2, 8)]
    for name, dates in (("signals", signals), ("calendar", [*signals, 20260102, 20260103])):
        spark.createDataFrame([(d,) for d in dates], "Date int").write.parquet(str(tmp_path / name))
    out = jobs.build_splits(spark, str(tmp_path / "signals"), str(tmp_path / "calendar"), str(tmp_path / "roles.csv"))
    roles = S.read_date_roles(spark, out)
    assert roles.count() == 108
    from panelwright.operators.calendar import active_split_dates

    assert active_split_dates(roles, "F1", "train").count() == 7 * 6 - 3


def test_backtest_job(spark, tmp_path):
    base = [-1.5, -0.5, 0.5, 1.5]
    dates = [20240102, 20240103, 20250102, 20250103]
    for k, model in enumerate(EIGHT_MODELS):
        rows = [(d, f"{i + 1:06d}", base[i] + k * 0.01, base[i] + (0.1, -0.1, 0.2, -0.2)[n]) for n, d in enumerate(dates) for i in range(4)]
        spark.createDataFrame(rows, "Date int, Code string, prediction double, raw_return double").write.parquet(str(tmp_path / "in" / f"{model}.parquet"))
    out = jobs.backtest(spark, str(tmp_path / "in"), str(tmp_path / "out"), files=True)
    portfolio = spark.read.option("header", True).csv(f"{out}/portfolio_summary").toPandas()
    predictive = spark.read.option("header", True).csv(f"{out}/predictive_summary").toPandas()
    assert set(portfolio["period"]) == {"2024-2025", "2024", "2025"} and len(portfolio) == 3 * 9 * 8
    assert set(predictive["model"]) == {*EIGHT_MODELS, "ensemble"}
    assert spark.read.parquet(f"{out}/ensemble_predictions").count() == 16
    assert spark.read.option("header", True).csv(f"{out}/prediction_correlation").count() == 64


@pytest.mark.parametrize("preset", ["lgb", "xgb"])
def test_trees_choose_a_round_and_reload(spark, tmp_path, preset):
    rng = np.random.default_rng(11)
    rows = []
    for day in range(8):
        signal, noise = np.linspace(-1, 1, 10), rng.normal(scale=0.1, size=10)
        rows += [(day, f"S{i:02d}", float(signal[i]), float(noise[i]), float(signal[i] + 0.05 * noise[i])) for i in range(10)]
    data = spark.createDataFrame(rows, "Date int, Code string, signal double, noise double, target double")
    train, valid = data.filter("Date < 5"), data.filter("Date >= 5")
    model, history = learn.train_on_panel(
        train, valid, ["signal", "noise"], "target", preset, patience=3, maxIter=6, maxDepth=3, minInstancesPerNode=1, stepSize=0.1, maxBins=32,
    )
    table = {r["round"]: r.daily_ic for r in history.collect()}
    best = max(table.values())
    assert 1 <= model.getNumTrees <= 6 and best > 0.9
    assert table[model.getNumTrees] == best
    before = learn.predict(model, valid, ["signal", "noise"], "target").orderBy("Date", "Code").toPandas()
    learn.save_model(model, str(tmp_path / "model"))
    after = learn.predict(learn.load_model(str(tmp_path / "model")), valid, ["signal", "noise"]).orderBy("Date", "Code").toPandas()
    np.testing.assert_allclose(after["prediction"], before["prediction"], rtol=1e-9)
    staged = learn.staged_predictions(model, learn.feature_vectors(valid, ["signal", "noise"], "target"), ["Date", "Code"])
    last = staged.filter(f"round = {model.getNumTrees}").orderBy("Date", "Code").toPandas()
    np.testing.assert_allclose(last["prediction"], before["prediction"], rtol=1e-9)


def test_first_best_round_wins(spark):
    rows = [(1, 0.1), (2, 0.3), (3, 0.3), (4, 0.2), (5, 0.9)]
    metrics = spark.createDataFrame(rows, "round int, daily_ic double")
    assert learn.best_round(metrics, patience=2).first().asDict() == {"best_round": 2, "best_ic": 0.3, "last_round": 4}
    assert learn.best_round(metrics, patience=9).first().best_round == 5


def test_period_summaries(spark):
    rows = [(d, "m", "A", 1.0, 0.5) for d in (20240102, 20250102)]
    daily = P.backtest_grid(spark.createDataFrame(rows, "Date int, model string, Code string, score double, return double"))
    periods = {r.period for r in P.period_portfolio_summary(daily, "all").collect()}
    assert periods == {"all", "2024", "2025"}
