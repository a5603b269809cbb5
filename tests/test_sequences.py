"""Stored sequences give the rows of the windowed ones, without an exchange."""

import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import sequences as S
from panelwright.operators import universe as U

DAYS = [20240102 + i for i in range(24)]


@pytest.fixture(scope="module")
def panel(spark):
    draw = random.Random(2)
    rows = [(f"{c:06d}", d, draw.random(), draw.random(), d % 3, "x") for c in range(30) for d in DAYS if draw.random() < 0.93]
    rows += [("000001", 20241231, 0.5, 0.5, 0, "off the calendar"), ("000002", DAYS[3] * 10, 0.1, 0.1, 0, "off")]
    return spark.createDataFrame(rows, "Code string, Date int, a double, b double, k int, note string")


@pytest.fixture(scope="module")
def calendar(spark):
    return spark.createDataFrame([(d,) for d in DAYS], "Date int")


def plain(frame, *names):
    return sorted((r.Code, r.Date, *[r[n] for n in names], [list(v) for v in r.sequence]) for r in frame.collect())


@pytest.mark.parametrize("length", [1, 4, 10])
def test_same_rows_as_windows(spark, panel, calendar, length):
    table = S.store_sessions(panel, ["a", "b"], calendar, keep=["k"], buckets=5)
    want = U.sequence_windows(panel, ["a", "b"], calendar, length, keep=["k"])
    assert plain(S.stored_sequences(spark, table, length=length, keep=["k"]), "k") == plain(want, "k")
    some = S.stored_sequences(spark, table, F.col("k") == 1, length)
    assert plain(some) == plain(want.filter("k = 1"))
    history = {tuple(r) for r in S.stored_history(spark, table, length).collect()}
    assert history == {tuple(r) for r in U.complete_history_universe(panel, calendar, length).collect()}
    S.drop_store(spark, table)


def test_no_exchange_on_reading(spark, panel, calendar):
    table = S.store_sessions(panel, ["a", "b"], calendar, buckets=5)
    for frame in (S.stored_sequences(spark, table, F.col("Date") > DAYS[12]), S.stored_history(spark, table)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    assert "features" not in S.stored_history(spark, table)._jdf.queryExecution().executedPlan().toString()


def test_strict_and_broken_stores(spark, panel, calendar):
    table = S.store_sessions(panel, ["a"], calendar, buckets=3)
    with pytest.raises(Exception, match="lacks 10 sessions"):
        S.stored_sequences(spark, table, strict=True).collect()
    double = S.store_sessions(panel.unionByName(panel), ["a"], calendar, buckets=3)
    with pytest.raises(Exception, match="two rows of one date"):
        S.stored_sequences(spark, double).collect()
    with pytest.raises(Exception, match="lacks a key"):
        S.store_sessions(panel.withColumn("Code", F.lit(None).cast("string")), ["a"], calendar)
    empty = S.store_sessions(panel.limit(0), ["a"], calendar, buckets=3)
    assert S.stored_sequences(spark, empty).count() == 0 == S.stored_history(spark, empty).count()
