"""Added dates equal a full rebuild, and read the sessions they need."""

import os
import random

import numpy as np
import pandas as pd
import pytest

from panelwright.plans import incremental, jobs
from panelwright.sources import tables as S

SESSIONS = [int(d) for d in pd.bdate_range("2024-01-02", periods=92).strftime("%Y%m%d")]
MINUTES = (930, 931, 945, 1005, 1040, 1131 - 1, 1301, 1400, 1455)


@pytest.fixture(scope="module")
def market(tmp_path_factory):
    """Twelve stocks: 2 was away for long, 3 and 4 now and then, 5 is new, 6 came back on the last day."""
    root, draw = tmp_path_factory.mktemp("market"), random.Random(8)
    os.makedirs(root / "daily")
    away = {2: set(range(20, 70)), 3: set(range(0, 92, 3)), 4: {85, 86}, 5: set(range(80)), 6: set(range(10, 91))}
    price = {c: 10.0 + c for c in range(12)}
    for i, date in enumerate(SESSIONS):
        rows, minutes = [], []
        for c in range(12):
            if i in away.get(c, ()):
                continue
            before, price[c] = price[c], price[c] * (1 + draw.gauss(0, 0.02))
            p = price[c]
            rows.append((f"{c}.SZ", p * 0.99, p * 1.02, p * 0.98, p, before, 10.0 + draw.random(), 10.0 * p, 1.0 + c / 10))
            minutes += [(m, f"{c}.SZ", p * (1 + draw.gauss(0, 0.002)), 10.0 + draw.random()) for m in MINUTES]
        pd.DataFrame(rows, columns=["Code", "open", "high", "low", "close", "pre_close", "vol", "amount", "adj_factor"]).to_parquet(root / "daily" / f"{date}.parquet")
        if i >= 86:
            os.makedirs(root / "minutes" / str(date))
            frame = pd.DataFrame(minutes, columns=["Minute", "Code", "close", "vol"])
            for m, part in frame.groupby("Minute"):
                part = part.assign(open=part.close * 0.999, high=part.close * 1.001, low=part.close * 0.998, amount=part.close * part.vol)
                part.drop(columns="Minute").to_parquet(root / "minutes" / str(date) / f"{m:04d}.parquet")
    return root


def table(spark, path, dates):
    rows = spark.read.parquet(path).toPandas()
    rows = rows[rows["Date"].isin(dates)].sort_values(["Date", "Code"]).reset_index(drop=True)
    return rows[["Code", "Date", *sorted(c for c in rows.columns if c not in ("Code", "Date"))]]


@pytest.mark.parametrize("protocol", ["de"])
def test_added_dates_equal_a_rebuild(spark, market, tmp_path, monkeypatch, protocol):
    daily, minutes, out = str(market / "daily"), str(market / "minutes"), str(tmp_path / "out")
    read = []
    plain = S.read_sessions_of

    def noted(spark, directory, dates):
        read.append(sorted(dates))
        return plain(spark, directory, dates)

    monkeypatch.setattr(S, "read_sessions_of", noted)
    last = SESSIONS[90:91] if protocol == "de" else SESSIONS[91:]
    first = SESSIONS[87:90]
    assert incremental.add_dates(spark, daily, minutes, out, first, SESSIONS, protocol, keep_raw=True) == first
    read.clear()
    asked = [*first, *(SESSIONS[90:91]), *last]
    assert incremental.add_dates(spark, daily, minutes, out, asked[:4], SESSIONS, protocol, keep_raw=True) == [SESSIONS[90]]
    assert read[0] == SESSIONS[30:91]  # the session and the 60 before it
    assert all(len(r) == 1 or set(r) <= set(SESSIONS[:30]) for r in read[1:])  # older ones for stocks that were away
    if protocol == "o2o":
        incremental.add_dates(spark, daily, minutes, out, asked, SESSIONS, protocol, keep_raw=True)
    dates = sorted(set(asked))
    assert incremental.finished_dates(spark, out) == dates
    spark.createDataFrame([(d,) for d in SESSIONS], "Date int").write.mode("overwrite").parquet(str(tmp_path / "days"))
    jobs.build_features(
        spark, daily, minutes, str(tmp_path / "full"), protocol, str(tmp_path / "days"), str(tmp_path / "full_raw"), (dates[0], dates[-1]), tree=True,
    )
    for ours, whole in ((f"{out}/raw", "full_raw"), (f"{out}/features", "full")):
        a, b = table(spark, ours, dates), table(spark, str(tmp_path / whole), dates)
        assert list(a.columns) == list(b.columns) and a[["Code", "Date"]].equals(b[["Code", "Date"]])
        np.testing.assert_array_equal(a.iloc[:, 2:].to_numpy(float), b.iloc[:, 2:].to_numpy(float))
    assert np.isfinite(table(spark, f"{out}/raw", dates)["D1_RET_20D"]).sum() > 30
    rows = {r.Code: r.n for r in spark.read.parquet(f"{out}/rows").filter(f"Date = {dates[-1]}").collect()}
    counts = pd.concat([pd.read_parquet(market / "daily" / f"{d}.parquet") for d in SESSIONS if d <= dates[-1]])["Code"].value_counts()
    assert rows == {f"{c.split('.')[0]:0>6}": n for c, n in counts.items()}


def test_unknown_and_finished_dates(spark, market, tmp_path):
    with pytest.raises(ValueError, match="calendar"):
        incremental.add_dates(spark, str(market / "daily"), str(market / "minutes"), str(tmp_path), [20240101], SESSIONS)
    assert incremental.finished_dates(spark, str(tmp_path / "none")) == []
