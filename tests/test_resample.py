"""Bars from ticks: packed orders sort like the columns and need no sort."""

import random

from pyspark.sql import functions as F

from panelwright.operators import bars as B
from panelwright.plans import adapters as A

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_derived_bars_aggregate_by_hash(spark):
    for bars in (A.daily_bars(spark, SF), A.minute_bars(spark, SF)):
        assert "SortAggregate" not in plan(bars) and "HashAggregate" in plan(bars)


def struct_bars(ticks, order):
    tick = F.struct(*order, "price")
    return ticks.groupBy("k").agg(F.min(tick)["price"].alias("open"), F.max(tick)["price"].alias("close"))


def test_packed_order_sorts_like_its_columns(spark):
    draw = random.Random(4)
    rows = [
        (draw.randrange(5), draw.choice([-7, 0, 3, 10**15, 10**15 + 1]), draw.randrange(-3, 3), draw.randrange(10**6) / 100, draw.choice([0.25, 0.5]))
        for _ in range(3000)
    ]
    ticks = spark.createDataFrame(rows, "k int, a long, b int, c double, d double").withColumn("price", F.col("c") / F.col("d"))
    order = ["a", "b", "c", "d"]
    key = B.packed_order(ticks, order)
    assert ticks.select(key.alias("x")).dtypes == [("x", "decimal(38,0)")]
    sorted_by_key = [tuple(r) for r in ticks.withColumn("x", key).orderBy("x").select(*order).collect()]
    assert sorted_by_key == sorted(r[1:] for r in rows)
    got = B.resample_bars(ticks, ["k"], "price", order, {"n": F.lit(1)}).select("k", "open", "close")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, struct_bars(ticks, order).collect()))
    assert ticks.select(B.packed_order(ticks, ["b"]).alias("x")).dtypes == [("x", "bigint")]


def test_orders_that_do_not_fit_fall_back(spark):
    wide = spark.createDataFrame([(1, 0, 0, 0, "a", 0.5, None, 1.0), (1, 2**62, 2**62, 2**62, "b", 0.123, 1, 2.0)], "k int, x long, y long, z long, s string, f double, n int, price double")
    assert B.packed_order(wide, ["x", "y"]) is not None
    for order in (["x", "y", "z"], ["s"], ["f"], ["n"], ["x", "n"]):
        assert B.packed_order(wide, order) is None
        row = B.resample_bars(wide, ["k"], "price", order, {}).first()
        assert (row.high, row.low) == (2.0, 1.0) and {row.open, row.close} == {1.0, 2.0}
    assert B.packed_order(wide.limit(0), ["x"]) is None
    assert B.resample_bars(wide.limit(0), ["k"], "price", ["x"], {}).count() == 0
