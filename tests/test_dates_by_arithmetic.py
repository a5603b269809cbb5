from datetime import date

from pyspark.sql import functions as F

from panelwright.functions import keys as K


def test_integer_days_equal_days_read_from_text(frame):
    years = (1000, 1582, 1900, 1999, 2000, 2023, 2024, 9999)
    days = [y * 10000 + m * 100 + d for y in years for m in range(0, 14) for d in (0, 1, 28, 29, 30, 31, 32)]
    rows = frame([(v,) for v in [*days, None, -20240102, 2024, 202401023, 0]], "v bigint")
    both = rows.select("v", K.integer_datetime(F.col("v")).alias("a"), K.normalize_datetime(F.col("v")).alias("b")).collect()
    assert [(r.v, r.a) for r in both] == [(r.v, r.b) for r in both]
    assert {r.v: r.a for r in both}[20240229] == date(2024, 2, 29)
    text = rows.select(K.integer_datetime(F.col("v")).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert "make_date" in text and "format_string" not in text
