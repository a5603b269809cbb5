"""All jobs in turn on one small market."""

from checks.catalog import CHAIN_MODELS, run_chain

SF = "/root/testdata/sf0.01"


def test_every_job_feeds_the_next(spark, tmp_path):
    root = str(tmp_path / "chain")
    report = run_chain(spark, SF, root).toPandas()
    assert len(report) == 2 * 3 * 8 and set(report["model"]) == {*CHAIN_MODELS, "ensemble"} and set(map(str, report["period"])) == {"2024"}
    panel = spark.read.parquet(f"{root}/panel")
    assert panel.filter("is_scoreable").count() > 100 and len(panel.columns) == 560 + 6
    for preset in CHAIN_MODELS:
        history = spark.read.option("header", True).csv(f"{root}/models/history/{preset}/F1")
        assert 3 <= history.count() <= 9
    scores = spark.read.parquet(f"{root}/models/predictions")
    tested = panel.filter("is_eligible").join(spark.read.option("header", True).csv(f"{root}/roles.csv").filter("split = 'test' AND purged = 'false'").selectExpr("CAST(signal_date AS INT) AS Date"), "Date").count()
    assert scores.filter("split = 'test' AND model = 'xgb'").count() == tested > 50
    daily = spark.read.parquet(f"{root}/report/daily_portfolios")
    assert daily.filter("Date < '2024-01-01'").count() == 0 and daily.select("Date").distinct().count() >= 5
