import math

from checks.catalog import rounded


def test_rounding_keeps_what_has_no_fraction(frame):
    values = [math.inf, -math.inf, math.nan, 1e14, -3e15, 1.2345674, -1.2345678, 0.0000025, None]
    rows = frame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.v for r in rounded(rows).orderBy("i").collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:5] == [1e14, -3e15]
    assert got[5:8] == [1.234567, -1.234568, 0.000003] and got[8] is None
    assert [r.v for r in rounded(rows, 2, ["i"]).orderBy("i").collect()][5] == 1.2345674
