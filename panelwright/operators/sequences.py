"""Sequences read from a table that is stored in session order.

``store_sessions`` writes a panel once, bucketed by Code: one exchange for the life of the table.  Every later
read groups the stocks in place.  A task walks the history of one stock at a time (one row a session, so it is
bounded by the calendar) and cuts out the windows of the asked rows only; other rows are never
copied into windows.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import SEQUENCE_LENGTH
from ..session import shared_folder
from .calendar import sessions
from .contracts import require_columns, row_guard

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ("Code", "Date")
BUCKETS = 64


def store_sessions(
    panel: DataFrame, names: Sequence[str], calendar: DataFrame | None = None, keep: Sequence[str] = (), buckets: int = BUCKETS,
    path: str | None = None, table: str | None = None,
) -> str:
    """Write ``Code, Date, session, <keep>, features`` bucketed by Code; returns the table's name.

    ``features`` are the FLOAT columns *names* as one array; ``session`` is the place of the date in the
    calendar (default: the dates of the panel), NULL off the calendar.
    """
    require_columns(panel, (*KEYS, *names, *keep), "panel")
    spark = panel.sparkSession
    days = sessions(calendar if calendar is not None else panel.select("Date")).select("Date", "session")
    vector = F.array(*[F.col(name).cast("float") for name in names])
    rows = panel.select(*KEYS, *keep, vector.alias("features"))
    rows = rows.filter(row_guard(F.col("Code").isNotNull() & F.col("Date").isNotNull(), "a panel row lacks a key"))
    rows = rows.join(F.broadcast(days), "Date", "left")  # one row per trading day
    table = table or f"sessions_{uuid.uuid4().hex}"
    path = path or f"{shared_folder(spark).rstrip('/')}/{table}"
    rows = rows.select("Code", "Date", "session", *keep, "features").repartition(buckets, "Code")
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, "Code").sortBy("Code", "Date").saveAsTable(table)
    return table


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows of a stock by date, the dates, and the sessions (-1 off the calendar)."""
    table = table.sort_by("Date").combine_chunks()
    dates = table["Date"].to_numpy()
    if (dates[1:] == dates[:-1]).any():
        raise ValueError("a stock has two rows of one date")
    return table, dates, table["session"].fill_null(-1).to_numpy()


def _complete(session: np.ndarray, length: int) -> np.ndarray:
    """Rows that end a run of *length* sessions in a row."""
    done = np.zeros(len(session), bool)
    if len(session) >= length:
        last, first = session[length - 1 :], session[: len(session) - length + 1]
        off = np.cumsum(np.r_[0, session < 0])
        done[length - 1 :] = (last - first == length - 1) & (off[length:] == off[:-length])
    return done


def stored_sequences(
    spark: SparkSession, table: str, where: Column | None = None, length: int = SEQUENCE_LENGTH, keep: Sequence[str] = (), strict: bool = False,
) -> DataFrame:
    """``Code, Date, <keep>, sequence`` of the stored rows that *where* marks: *length* vectors, oldest first.

    A marked row without a complete history gives no row, or with *strict* fails the job.
    """
    if length < 1:
        raise ValueError("a sequence has one session at least")
    rows = spark.table(table)
    marked = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    rows = rows.select("Code", "Date", "session", *[c for c in keep if c not in KEYS], "features", marked.alias("_marked"))
    fields = [rows.schema[c] for c in ("Code", "Date", *[c for c in keep if c not in KEYS])]
    schema = T.StructType([*fields, T.StructField("sequence", T.ArrayType(T.ArrayType(T.FloatType())))])
    names = [f.name for f in fields]

    def cut(stock: pa.Table) -> pa.Table:
        stock, dates, session = _ordered(stock)
        wanted, done = stock["_marked"].to_numpy(), _complete(session, length)
        if strict and (wanted & ~done).any():
            raise ValueError(f"{stock['Code'][0]} lacks {length} sessions before {dates[wanted & ~done][0]}")
        at = np.flatnonzero(wanted & done)
        steps = (at[:, None] + np.arange(1 - length, 1)).ravel()
        vectors = stock["features"].combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * length)
        sequences = pa.ListArray.from_arrays(ends, vectors.take(pa.array(steps)))
        return pa.table([*[stock[c].take(pa.array(at)) for c in names], sequences], names=schema.names)

    return rows.groupBy("Code").applyInArrow(cut, schema)


def stored_history(spark: SparkSession, table: str, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """``Code, Date`` of the stored rows with a complete history (J2); reads three narrow columns."""
    rows = spark.table(table).select("Code", "Date", "session")
    schema = T.StructType([rows.schema["Code"], rows.schema["Date"]])

    def cut(stock: pa.Table) -> pa.Table:
        stock, _, session = _ordered(stock)
        return stock.select(["Code", "Date"]).take(pa.array(np.flatnonzero(_complete(session, length))))

    return rows.groupBy("Code").applyInArrow(cut, schema)


def drop_store(spark: SparkSession, table: str) -> None:
    """Forget the table; its files stay in the folder until that is cleaned."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
