"""Feature dates added to a finished table, instead of rebuilding it.

The output folder holds ``features`` (and ``raw`` on request), one partition a date; ``finished``, the
dates that are done with their row counts; and ``rows``, for the last date of every addition how many daily
rows each stock has had so far.  Adding a date reads the daily bars of that session and the 60 before it, and the
minutes of that session alone (with the next one for the early open).  Look-backs count rows of the stock,
so a stock that was away has part of its 60 rows further back: ``rows`` tells which stocks those are, and
only their rows are fetched from older sessions.  Every value equals that of a full rebuild.

Features are written first and the date is marked last, so a broken run is repeated from the start of its dates.
A ``vwap`` column that is empty in some sessions and filled in others is outside this contract, since bars decide
on it for all rows they are given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry as R
from ..operators.bars import code_of, prepare_daily_panel
from ..operators.features import raw_feature_panel
from ..session import stage
from ..sources import tables as S
from . import jobs

LOOKBACK = 60


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def finished_dates(spark: SparkSession, output: str) -> list[int]:
    """The dates that are done, one small row each."""
    table = _read(spark, f"{output}/finished")
    return [] if table is None else sorted(r.Date for r in table.select("Date").distinct().collect())


def _keys(bars: DataFrame) -> DataFrame:
    """The (Code, Date) rows that the daily features will see."""
    return prepare_daily_panel(bars).select("Code", "Date")


def rows_so_far(spark: SparkSession, daily: str, output: str, sessions: Sequence[int], upto: int) -> DataFrame:
    """``Code, n``: daily rows of each stock up to a session, from the newest stored count and the sessions since."""
    stored = _read(spark, f"{output}/rows")
    base = None if stored is None else stored.filter(F.col("Date") <= upto).agg(F.max("Date")).first()[0]
    since = [d for d in sessions if d <= upto and (base is None or d > base)]
    parts = [] if base is None else [stored.filter(F.col("Date") == base).select("Code", "n")]
    if since:
        parts.append(_keys(S.read_sessions_of(spark, daily, since)).groupBy("Code").agg(F.count(F.lit(1)).alias("n")))
    if not parts:
        return spark.createDataFrame([], "Code string, n long")
    counted = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return counted.groupBy("Code").agg(F.sum("n").alias("n"))


def history_bars(spark: SparkSession, daily: str, output: str, sessions: Sequence[int], dates: Sequence[int], lookback: int = LOOKBACK) -> tuple[DataFrame, DataFrame]:
    """Daily bars that the look-backs of *dates* need, and the rows so far before the first of them."""
    sessions = sorted(sessions)
    first = sessions.index(min(dates))
    start = max(0, first - lookback)
    bars = S.read_sessions_of(spark, daily, [d for d in sessions[start:] if d <= max(dates)])
    before = stage(rows_so_far(spark, daily, output, sessions, sessions[first - 1]) if first else spark.createDataFrame([], "Code string, n long"))
    seen = _keys(bars).groupBy("Code").agg(F.count_if(F.col("Date") < min(dates)).alias("near"), F.count_if(F.col("Date") >= min(dates)).alias("asked"))
    # Stocks of the asked dates whose last rows lie further back than the window; one row a stock.
    short = seen.filter("asked > 0").join(before, "Code").filter(F.col("near") < F.least(F.col("n"), F.lit(lookback)))
    short = stage(short.select("Code", (F.least(F.col("n"), F.lit(lookback)) - F.col("near")).alias("lacking")))
    older, width = sessions[:start], lookback
    while older and not short.isEmpty():
        chunk, older, width = older[-width:], older[:-width], width * 2
        found = S.read_sessions_of(spark, daily, chunk)
        keyed = found.withColumn("_code", code_of(found))
        wanted = keyed.join(short.select(F.col("Code").alias("_code")), "_code", "left_semi").drop("_code")
        bars = bars.unionByName(stage(wanted))
        got = _keys(wanted).groupBy("Code").agg(F.count(F.lit(1)).alias("got"))
        short = stage(
            short.join(got, "Code", "left").select("Code", (F.col("lacking") - F.coalesce("got", F.lit(0))).alias("lacking")).filter("lacking > 0")
        )
    return bars, before


def add_dates(
    spark: SparkSession, daily: str, minutes: str, output: str, dates: Sequence[int], sessions: Sequence[int], protocol: str = "o2o",
    keep_raw: bool = False, again: bool = False,
) -> list[int]:
    """Add feature dates that are not finished yet (all of them with *again*); returns the dates added.

    ``daily`` holds ``YYYYMMDD.parquet`` files, ``minutes`` a tree of sessions, ``sessions`` is the trading calendar.
    """
    sessions = sorted(set(sessions))
    unknown = sorted(set(dates) - set(sessions))
    if unknown:
        raise ValueError(f"not in the calendar: {unknown}")
    todo = sorted(set(dates) - (set() if again else set(finished_dates(spark, output))))
    if not todo:
        return []
    asked = set(todo)
    if R.protocol_key(protocol) == "de":
        asked |= {sessions[i + 1] for i, d in enumerate(sessions[:-1]) if d in asked}
    bars, before = history_bars(spark, daily, output, sessions, todo)
    calendar = spark.createDataFrame([(d,) for d in sessions], "Date int")
    raw = raw_feature_panel(bars, S.read_session_tree(spark, minutes, asked), protocol, calendar)
    raw = raw.filter(F.col("Date").isin(todo))
    jobs.write_features(raw, f"{output}/features", protocol, f"{output}/raw" if keep_raw else None, only_own=True)
    span = [d for d in sessions if todo[0] <= d <= todo[-1]]
    now = before.unionByName(_keys(S.read_sessions_of(spark, daily, span)).groupBy("Code").agg(F.count(F.lit(1)).alias("n")))
    now = now.groupBy("Code").agg(F.sum("n").alias("n")).withColumn("Date", F.lit(todo[-1]))
    S.write_parquet(now, f"{output}/rows", ["Date"], only_own=True)
    done = spark.read.parquet(f"{output}/features").filter(F.col("Date").isin(todo)).groupBy("Date").agg(F.count(F.lit(1)).alias("n_rows"))
    S.write_parquet(done, f"{output}/finished", ["Date"], only_own=True)
    return todo
