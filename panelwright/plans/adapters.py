"""Deterministic market-like tables derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bars import merge_bars, resample_bars
from ..operators.calendar import Fold

# The derived data span 1995-2001 and January 2024.
DERIVED_FOLDS = (
    Fold("F1", (1995, 1998), (1999, 1999), (2000, 2000)),
    Fold("F2", (1996, 1999), (2000, 2000), (2001, 2001)),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _date_int(ts: Column) -> Column:
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


#: Suppliers and users that share a stock: the number of stocks grows with the tables, up to all codes of six digits.
SUPPLIERS, USERS, CODES = 4, 8, 1_000_000


def _stock(key: str, members: int) -> Column:
    return F.expr(f"{key} div {members} % {CODES}")


def _factor() -> Column:
    return 1 + (F.col("Code").cast("int") % 5) / F.lit(100.0)


def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of one code for every four suppliers of ``lineitem``; vol in lots, amount in thousands."""
    order = [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    ]
    # One numeric (code, date) key: it hashes and sorts without comparing text.
    packed = _stock("l_suppkey", SUPPLIERS) * 100_000_000 + _date_int(F.col("l_shipdate"))
    ticks = table(spark, folder, "lineitem").select(
        *order, packed.alias("stock_day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    )
    bars = resample_bars(
        ticks, ["stock_day"], "price", order, {"_q": F.col("l_quantity"), "_p": F.col("l_extendedprice")}
    )
    bars = bars.withColumns(
        {
            "Code": F.lpad(F.floor(F.col("stock_day") / 100_000_000).cast("string"), 6, "0"),
            "Date": (F.col("stock_day") % 100_000_000).cast("int"),
        }
    )
    before = F.lag("close").over(Window.partitionBy("Code").orderBy("Date"))
    return bars.select(
        "Code", "Date", "open", "high", "low", "close",
        F.coalesce(before, F.col("open")).alias("pre_close"),
        (F.col("_q") / 100).alias("vol"),
        (F.col("_p") / 1000).alias("amount"),
        _factor().alias("adj_factor"),
    )


def minute_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Minute bars of one code for every eight users of ``events``, squeezed onto the 241 session minutes."""
    ts = F.col("ts")
    place = F.floor((F.hour(ts) * 60 + F.minute(ts)) * 241 / F.lit(1440.0)).cast("int")
    clock = F.when(place <= 120, 570 + place).otherwise(781 + place - 121)
    ticks = table(spark, folder, "events").select(
        F.lpad(_stock("user_id", USERS).cast("string"), 6, "0").alias("Code"),
        _date_int(ts).alias("Date"),
        (F.floor(clock / F.lit(60.0)) * 100 + clock % 60).cast("int").alias("Minute"),
        F.col("value").alias("price"),
        (100 * (1 + F.col("event_id") % 10)).cast("double").alias("v"),
        "event_id",
    )
    bars = resample_bars(
        ticks, ("Code", "Date", "Minute"), "price", ["event_id"],
        {"vol": F.col("v"), "amount": F.col("price") * F.col("v")},
    )
    return bars.withColumn("adj_factor", _factor())


#: Session minutes of the short sessions, the first six of them those that labels are made of.
SHORT_SESSION = (930, 931, 932, 933, 934, 935, 945, 1005, 1040, 1110, 1301, 1331, 1400, 1420, 1440, 1455)


def short_sessions(spark: SparkSession, folder: str, years: tuple[int, ...]) -> DataFrame:
    """Minute bars of ``events`` on few minutes a session, its thirty days dealt out to *years* in order.

    Sessions are dense enough for labels, and years enough for folds: a small market for whole runs.
    """
    ts = F.col("ts")
    minutes = F.array(*[F.lit(m) for m in SHORT_SESSION])
    place = F.floor((F.hour(ts) * 60 + F.minute(ts)) * len(SHORT_SESSION) / F.lit(1440.0)).cast("int")
    each = -(-30 // len(years))
    day = F.dayofmonth(ts) - 1
    year = F.get(F.array(*[F.lit(y) for y in years]), F.least(F.floor(day / each), F.lit(len(years) - 1)).cast("int"))
    ticks = table(spark, folder, "events").select(
        F.lpad(_stock("user_id", USERS).cast("string"), 6, "0").alias("Code"),
        (year * 10000 + 100 + F.dayofmonth(ts)).cast("int").alias("Date"),
        F.get(minutes, place).alias("Minute"),
        F.col("value").alias("price"),
        (100 * (1 + F.col("event_id") % 10)).cast("double").alias("v"),
        "event_id",
    )
    bars = resample_bars(
        ticks, ("Code", "Date", "Minute"), "price", ["event_id"],
        {"vol": F.col("v"), "amount": F.col("price") * F.col("v")},
    )
    return bars.withColumn("adj_factor", _factor())


def intraday_daily_bars(minutes: DataFrame) -> DataFrame:
    """Daily reference of the minute bars; the previous close is the stock's last close."""
    bars = merge_bars(minutes, ("Code", "Date"), "Minute", F.col("vol") / 100, F.col("amount") / 1000)
    before = F.lag("close").over(Window.partitionBy("Code").orderBy("Date"))
    return bars.withColumn("pre_close", F.coalesce(before, F.col("open"))).withColumn("adj_factor", _factor())


def calendar_of(bars: DataFrame) -> DataFrame:
    return bars.select("Date").distinct()


def eligibility_of(bars: DataFrame) -> DataFrame:
    """Entry-session flags by arithmetic on code and date, some of them NULL."""
    seed = F.col("Code").cast("int") + F.col("Date")

    def flag(modulus: int, missing: int) -> Column:
        return F.when(seed % missing != 0, seed % modulus == 0)

    return bars.select(
        "Code", "Date",
        flag(17, 101).alias("is_st"),
        flag(19, 103).alias("is_limit_up_open"),
        flag(23, 107).alias("is_limit_down_open"),
    )
