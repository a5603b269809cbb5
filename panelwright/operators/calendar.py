"""Trading calendar, label endpoints and rolling date roles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import year_of
from .contracts import require_empty, row_guard

# Signal dates marked at the tail of each split, and the split names.
PURGE_SIGNAL_DATES = 3
SPLITS = ("train", "validation", "test")


@dataclass(frozen=True)
class Fold:
    """Inclusive year ranges of one rolling fold."""

    fold_id: str
    train: tuple[int, int]
    validation: tuple[int, int]
    test: tuple[int, int]

    def __post_init__(self) -> None:
        for years in (self.train, self.validation, self.test):
            if years[0] > years[1]:
                raise ValueError(f"the first year comes after the last: {years}")


# The two registered folds.
FIXED_FOLDS = (
    Fold("F1", (2016, 2022), (2023, 2023), (2024, 2024)),
    Fold("F2", (2017, 2023), (2024, 2024), (2025, 2025)),
)


def sessions(calendar: DataFrame) -> DataFrame:
    """``Date, session, entry_date, exit_date``: index and the next two sessions.

    One row per trading day: the un-partitioned window sorts the calendar only.
    """
    days = calendar.select("Date").distinct()
    order = Window.orderBy("Date")
    return days.select(
        "Date",
        F.row_number().over(order).alias("session"),
        F.lead("Date", 1).over(order).alias("entry_date"),
        F.lead("Date", 2).over(order).alias("exit_date"),
    )


def map_endpoints(signal_dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """Signal dates on the calendar with two later sessions, and those sessions."""
    ends = sessions(calendar).filter(F.col("exit_date").isNotNull())
    signals = signal_dates.select("Date").distinct()
    return signals.join(ends, "Date").select(F.col("Date").alias("signal_date"), "entry_date", "exit_date")


def _dated(dates: DataFrame) -> DataFrame:
    """Distinct dates and their years; a date that is not ``YYYYMMDD`` fails the job."""
    known = dates.select("Date").distinct().withColumn("year", year_of(F.col("Date")))
    return known.filter(row_guard(F.col("year").isNotNull(), "dates must be YYYYMMDD integers"))


def dates_in_years(dates: DataFrame, first: int, last: int) -> DataFrame:
    """Distinct dates whose year lies in an inclusive range."""
    if first > last:
        raise ValueError(f"the first year comes after the last: {(first, last)}")
    return _dated(dates).filter(F.col("year").between(first, last)).select("Date")


def date_roles(
    signal_dates: DataFrame,
    calendar: DataFrame,
    folds: Sequence[Fold] = FIXED_FOLDS,
    purge: int = PURGE_SIGNAL_DATES,
) -> DataFrame:
    """``fold_id, split, signal_date, entry_date, exit_date, purged`` for every fold.

    The last *purge* signal dates present in a split are marked.  A signal date
    inside a split without two later sessions fails the job.
    """
    if purge < 0:
        raise ValueError("purge cannot be negative")
    spark = signal_dates.sparkSession
    ranges = [(fold.fold_id, split, *getattr(fold, split)) for fold in folds for split in SPLITS]
    # A handful of parameter rows: years are matched by an equi-join on the exploded year.
    years = spark.createDataFrame(ranges, "fold_id string, split string, lo int, hi int").select(
        "fold_id", "split", F.explode(F.sequence("lo", "hi")).alias("year")
    )
    signals = _dated(signal_dates)
    placed = signals.join(F.broadcast(years), "year").join(sessions(calendar), "Date", "left")
    latest_first = Window.partitionBy("fold_id", "split").orderBy(F.desc("signal_date"))
    placed = placed.select("fold_id", "split", F.col("Date").alias("signal_date"), "entry_date", "exit_date")
    placed = placed.withColumn("_place", F.row_number().over(latest_first))
    # Above the window the guard is a filter that needs its rows, so no select prunes it or moves it into the join.
    ends = F.col("exit_date").isNotNull() & (F.col("_place") >= 1)
    placed = placed.filter(row_guard(ends, "signal dates lack calendar endpoints"))
    return placed.withColumn("purged", F.col("_place") <= purge).drop("_place")


def date_role_violations(roles: DataFrame, purge: int = PURGE_SIGNAL_DATES) -> DataFrame:
    """``fold_id, problem`` rows: endpoint order, overlaps, empty splits, wrong purge."""
    order = roles.filter(
        ~((F.col("signal_date") < F.col("entry_date")) & (F.col("entry_date") < F.col("exit_date")))
    ).select("fold_id", F.lit("endpoint order").alias("problem"))
    unknown = roles.filter(~F.col("split").isin(*SPLITS)).select("fold_id", F.lit("unknown split").alias("problem"))
    active = roles.filter(~F.col("purged"))
    overlap = (
        active.groupBy("fold_id", "signal_date")
        .agg(F.countDistinct("split").alias("n"))
        .filter(F.col("n") > 1)
        .select("fold_id", F.lit("overlapping splits").alias("problem"))
    )
    empty = (
        roles.groupBy("fold_id")
        .agg(F.countDistinct(F.when(~F.col("purged"), F.col("split"))).alias("n"))
        .filter(F.col("n") < len(SPLITS))
        .select("fold_id", F.lit("empty active split").alias("problem"))
    )
    latest_first = Window.partitionBy("fold_id", "split").orderBy(F.desc("signal_date"))
    split_size = F.count(F.lit(1)).over(Window.partitionBy("fold_id", "split"))
    tail = (
        roles.withColumns({"place": F.row_number().over(latest_first), "size": split_size})
        .filter((F.col("purged") != (F.col("place") <= purge)) | (F.col("size") < purge))
        .select("fold_id", F.lit("purge is not the split tail").alias("problem"))
    )
    return order.unionByName(unknown).unionByName(overlap).unionByName(empty).unionByName(tail)


def check_date_roles(roles: DataFrame, purge: int = PURGE_SIGNAL_DATES) -> None:
    """Fail when the role table is empty or breaks a rule."""
    if roles.isEmpty():
        raise ValueError("date-role table is empty")
    require_empty(date_role_violations(roles, purge), "invalid date roles")


def active_roles(roles: DataFrame) -> DataFrame:
    """Roles without the purged tail; accepts text flags from a CSV."""
    flag = F.lower(F.col("purged").cast("string"))
    return roles.filter(~F.coalesce(flag.isin("true", "1"), F.lit(False)))


def active_split_dates(roles: DataFrame, fold: str, split: str) -> DataFrame:
    """Active signal dates of one fold and split, as a one-column frame."""
    chosen = active_roles(roles).filter((F.col("fold_id") == fold) & (F.col("split") == split))
    return chosen.select(F.col("signal_date").cast("int").alias("Date")).distinct()
