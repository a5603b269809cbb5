from pyspark.sql import functions as F

from panelwright.functions import keys as K
from panelwright.operators import bars as B
from panelwright.operators import features
from panelwright.session import METHOD_BYTES

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_wide_features_keep_generated_methods_compilable(spark, frame):
    schema = "Code string, Date int, open double, high double, low double, close double, pre_close double, vol double, amount double"
    bars = frame([("000001", 20240102, 1.0, 2.0, 1.0, 2.0, 1.0, 3.0, 4.0)], schema)
    before = spark.conf.get(LIMIT)
    try:
        spark.conf.unset(LIMIT)
        features.daily_features(B.prepare_daily_panel(bars))
        assert int(spark.conf.get(LIMIT)) == METHOD_BYTES
        spark.conf.set(LIMIT, "5000")  # a limit of the user stays
        features.daily_features(B.prepare_daily_panel(bars))
        assert spark.conf.get(LIMIT) == "5000"
    finally:
        spark.conf.set(LIMIT, before)


def test_prefixes_need_no_pattern(frame):
    codes = frame([("000001",), ("300001",), ("688001",), ("900001",), ("A.B",), ("AxB",), ("",), (None,)], "c string")
    found = [r.f for r in codes.select(K.has_prefix(F.col("c"), ("0", "68", "A.", "3")).alias("f")).collect()]
    assert found == [True, True, True, False, True, False, False, False]
    assert not any(r.f for r in codes.select(K.has_prefix(F.col("c"), ()).alias("f")).collect())
    assert [r.f for r in codes.select(K.has_prefix(F.col("c"), ("",)).alias("f")).collect()] == [True] * 7 + [False]


def test_joins_of_the_raw_panel_see_structs_and_stages_no_dictionaries(spark):
    import pyarrow.parquet as pq

    from panelwright.operators.features import raw_feature_panel
    from panelwright.session import stage

    bars = spark.createDataFrame(
        [("1", 20240102 + d, m, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for d in range(2) for m in (930, 931, 1000)],
        "Code string, Date int, Minute int, open double, high double, low double, close double, vol double, amount double",
    )
    daily = bars.filter("Minute = 930").drop("Minute").selectExpr("*", "1D AS pre_close")
    panel = raw_feature_panel(daily, bars, "de")
    plan = panel._jdf.queryExecution().optimizedPlan()
    todo, widths = [plan], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "Join":
            widths.append(node.output().length())
        todo += [node.children().apply(i) for i in range(node.children().length())]
    assert len(widths) >= 2 and max(widths) < 100
    staged = stage(panel)
    assert staged.count() == 2 and len(staged.columns) == 659
    used = [c for f in staged.inputFiles() for g in [pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0)] for c in [g.column(2).encodings]]
    assert used and not any("DICTIONARY" in e for encodings in used for e in encodings)
