import pytest
from pyspark.sql import functions as F

from panelwright.functions import keys as K
from panelwright.functions import safe as S
from panelwright.operators import contracts as D


def test_normalised_codes(frame):
    raw = ["1", " 600000.SH ", "ab_1", "1234567", "x#1", "", None, "000002.SZ.X", "A" * 33]
    rows = frame([(v,) for v in raw], "raw string").select(K.normalize_code(F.col("raw")).alias("c")).collect()
    assert [r.c for r in rows] == ["000001", "600000", "AB_1", None, None, None, None, "000002", None]


def test_normalised_dates(frame):
    raw = ["2024-01-02", "20240102 09:30", "2024/1/2", "20241399", "2024", None]
    rows = frame([(v,) for v in raw], "raw string").select(
        K.normalize_date(F.col("raw")).alias("d"), K.normalize_datetime(F.col("raw")).cast("string").alias("t")
    ).collect()
    assert [r.d for r in rows] == [20240102, 20240102, None, 20241399, None, None]
    assert [r.t for r in rows] == ["2024-01-02", "2024-01-02", None, None, None, None]


def test_normalised_minutes_and_slots(frame):
    cases = {
        "930": 930, "930.0": 930, "09:30": 930, "9:31:00": 931, "15:00:00.5": 1500, "0": 0, "2400": None, "1260": None,
        "24:00": None, "12345": None, "60": None, "5": 5, "x": None, "00930": None,
    }
    rows = frame([(v,) for v in cases], "raw string").select(
        "raw", K.normalize_minute(F.col("raw")).alias("m")
    ).collect()
    assert {r.raw: r.m for r in rows} == cases
    slots = {929: None, 930: 1, 1000: 1, 1001: 2, 1030: 2, 1031: 3, 1130: 4, 1131: None, 1300: None, 1301: 5, 1330: 5, 1331: 6, 1430: 7, 1431: 8, 1500: 8, 1501: None}
    got = frame([(m,) for m in slots], "m int").select("m", K.session_slot(F.col("m")).alias("s")).collect()
    assert {r.m: r.s for r in got} == slots
    minutes = frame([(h * 100 + m,) for h in range(24) for m in range(60)], "m int")
    counts = minutes.groupBy(K.session_slot(F.col("m")).alias("s")).count().filter("s IS NOT NULL").collect()
    assert {r.s: r["count"] for r in counts} == {1: 31} | {s: 30 for s in range(2, 9)}


def test_safe_arithmetic(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 2.0), (1.0, 0.0), (1.0, 1e-13), (inf, 1.0), (1.0, inf), (nan, 1.0), (None, 1.0), (-1.0, 0.0), (0.0, 0.0)]
    got = frame(rows, "a double, b double").select(
        S.ratio(F.col("a"), F.col("b")).alias("q"),
        S.step_return(F.nanvl("a", F.lit(None)), F.col("b")).alias("s"),
        S.both_max(F.col("a"), F.lit(0.0)).alias("m"),
        S.number(F.col("a")).alias("n"),
    ).collect()
    assert [r.q for r in got] == [0.5] + [None] * 8
    assert [r.s for r in got][:3] == [-0.5, inf, 1e13 - 1] and got[7].s == -inf and got[8].s is None
    assert got[6].m is None and got[7].m == 0.0
    assert got[5].n is None and got[3].n == inf


def test_key_contracts(frame):
    good = frame([("a", 1), ("b", 1)], "Code string, Date int")
    bad = frame([("a", 1), ("a", 1), (None, 2)], "Code string, Date int")
    D.require_keys(good)
    with pytest.raises(D.ContractError, match="null"):
        D.require_keys(bad)
    with pytest.raises(D.ContractError, match="duplicate"):
        D.require_unique(bad)
    assert {r["check"]: (r.n_keys, r.n_rows) for r in D.key_violations(bad).collect()} == {"null_key": (1, 1), "duplicate_key": (1, 2)}
    scores = frame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "s double")
    assert D.non_finite(scores, ["s"]).count() == 3
    with pytest.raises(D.ContractError, match="missing required columns"):
        D.require_columns(good, ["ret"])
