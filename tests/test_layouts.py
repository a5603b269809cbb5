"""Session trees, single sessions and writes balanced by size."""

import os

import pytest

from panelwright.operators import bars as B
from panelwright.sources import tables as S

BAR = "Code string, open double, high double, low double, close double, vol double, amount double"


def bar(code, price):
    return (code, price, price + 1, price - 1, price, 10.0, 1000.0)


@pytest.fixture
def tree(spark, tmp_path):
    for date in (20240102, 20240103, 20240104):
        os.makedirs(tmp_path / str(date))
        for i, minute in enumerate(("0930", "0931", "1301")):
            spark.createDataFrame([bar("1", 5.0 + i), bar("600000.SH", 7.0 + i)], BAR).toPandas().to_parquet(tmp_path / str(date) / f"{minute}.parquet")
    return str(tmp_path)


def test_tree_feeds_the_minute_panel(spark, tree):
    panel = B.prepare_minute_panel(S.read_session_tree(spark, tree), prefixes=("0", "6"))
    rows = {(r.Code, r.Date, r.Minute): r.close for r in panel.collect()}
    assert len(rows) == 18 and rows["000001", 20240103, 1301] == 7.0 and rows["600000", 20240104, 931] == 8.0


def test_only_the_asked_folders_are_read(spark, tree):
    some = S.read_session_tree(spark, tree, [20240103])
    assert {f.split("/")[-2] for f in some.inputFiles()} == {"20240103"} and {r.Date for r in some.collect()} == {20240103}
    late = S.read_session_tree(spark, tree).filter("Date = 20240104")
    late.collect()
    scans = [x for x in late._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert len(scans) == 1 and late.count() == 6
    node = late._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    assert node.metrics().apply("numFiles").value() == 3


def test_daily_text_and_single_sessions(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("Code,Date,close\n000001,20240102,1.5\n")
    assert S.read_daily_bars(spark, str(tmp_path / "bars.csv")).first().Code == "000001"
    for date in (20240102, 20240103, 20240104):
        spark.createDataFrame([bar("1", 5.0)], BAR).toPandas().to_parquet(tmp_path / f"{date}.parquet")
    two = S.read_sessions_of(spark, str(tmp_path), [20240102, 20240104])
    assert len(two.inputFiles()) == 2 and {r.Date for r in two.collect()} == {20240102, 20240104}


def test_large_dates_are_split_and_small_ones_are_not(spark, tmp_path):
    rows = spark.range(0, 330_000, 1, 6).selectExpr(
        "CAST(CASE WHEN id < 300000 THEN 20240102 ELSE 20240103 + id % 10 END AS INT) AS Date", "CAST(id AS STRING) AS Code", "rand(1) AS x", "rand(2) AS y"
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        path = S.write_parquet(rows, str(tmp_path / "t"), ["Date"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {d: len([f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")]) for d in os.listdir(path) if d.startswith("Date=")}
    assert files["Date=20240102"] > 3 and all(n == 1 for d, n in files.items() if d != "Date=20240102") and len(files) == 11
    assert spark.read.parquet(path).count() == 330_000
    one = rows.filter("Date = 20240105").limit(5)
    S.write_parquet(one, path, ["Date"], only_own=True)
    assert spark.read.parquet(path).filter("Date = 20240105").count() == 5 and spark.read.parquet(path).count() == 330_000 - 3_000 + 5
