"""Eligible universe, model panel, samples and sequence windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.safe import finite, is_finite, number
from ..registry import SEQUENCE_LENGTH
from ..session import stage
from .calendar import active_split_dates, sessions
from .contracts import conflicting_entry_dates, require_columns, require_empty, row_guard
from .groups import profile_groups
from .labels import zscore_by_date

KEYS = ("Code", "Date")
FLAGS = ("is_st", "is_limit_up_open", "is_limit_down_open")


def normalized_keys(frame: DataFrame) -> DataFrame:
    """Normalise Code and Date; an invalid key fails the job."""
    bad = F.raise_error(F.lit("Code or Date of a row cannot be read"))
    return frame.withColumns(
        {
            "Code": F.coalesce(K.normalize_code(F.col("Code")), bad.cast("string")),
            "Date": F.coalesce(K.normalize_date(F.col("Date")), bad.cast("int")),
        }
    )


def entry_to_signal(roles: DataFrame) -> DataFrame:
    """Distinct ``entry_date -> signal_date`` map of a role table; conflicts are an error."""
    pairs = roles.select(
        K.normalize_date(F.col("entry_date")).alias("entry_date"),
        K.normalize_date(F.col("signal_date")).alias("signal_date"),
    ).distinct()
    require_empty(conflicting_entry_dates(pairs), "an entry date maps to more than one signal date")
    return pairs


def on_entry_dates(entry_panel: DataFrame, mapping: DataFrame) -> DataFrame:
    """Keep eligibility rows whose Date is an entry date of the role table."""
    dates = mapping.select(F.col("entry_date").alias("_entry")).distinct()  # one row per trading day
    date = K.normalize_date(F.col("Date"))
    return entry_panel.join(F.broadcast(dates), date == F.col("_entry"), "left_semi")


def entry_eligible_universe(
    entry_panel: DataFrame, mapping: DataFrame, prefixes: Sequence[str] = K.CODE_PREFIXES
) -> DataFrame:
    """Eligible ``Code, Date(signal)``: allowed prefix, no ST, no limit at the entry open.

    A missing flag counts as set.  An entry date without a signal date fails the job.
    """
    require_columns(entry_panel, (*KEYS, *FLAGS), "eligibility panel")
    panel = normalized_keys(entry_panel.select(*KEYS, *FLAGS))
    eligible = K.has_prefix(F.col("Code"), prefixes)
    for flag in FLAGS:
        eligible = eligible & ~F.coalesce(F.col(flag).cast("boolean"), F.lit(True))
    # One row per trading day on the mapped side; an entry date of two signal dates fails.
    signals = mapping.groupBy(F.col("entry_date").alias("Date")).agg(F.min("signal_date").alias("signal_date"), F.max("signal_date").alias("_last"))
    one = F.col("signal_date").eqNullSafe(F.col("_last"))
    signals = signals.filter(row_guard(one, "an entry date maps to more than one signal date")).drop("_last")
    mapped = panel.join(F.broadcast(signals), "Date", "left")
    unmapped = F.raise_error(F.lit("entry dates must have a preceding session in the trading calendar"))
    date = F.coalesce(F.col("signal_date"), unmapped.cast("int"))
    return mapped.withColumn("_date", date).filter(eligible & (F.col("_date") > 0)).select(
        "Code", F.col("_date").alias("Date")
    )


def _session_run(frame: DataFrame, calendar: DataFrame, length: int) -> DataFrame:
    """Add ``complete``: the row and the stock's previous rows are *length* calendar sessions in a row.

    The window holds one row per session of a stock.
    """
    days = sessions(calendar).select("Date", "session")
    placed = frame.join(F.broadcast(days), "Date", "left")  # one row per trading day
    stock = Window.partitionBy("Code").orderBy("Date")
    run = stock.rowsBetween(1 - length, 0)
    # Off-calendar rows have no session; counting sessions in the run makes them break it.
    consecutive = (F.col("session") - F.lag("session", length - 1).over(stock) == length - 1) & (
        F.count("session").over(run) == length
    )
    return placed.withColumn("complete", F.coalesce(consecutive, F.lit(False)))


def complete_history_universe(
    features: DataFrame, calendar: DataFrame, length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """Stock-days whose trailing *length* rows cover *length* consecutive sessions."""
    if length < 1:
        raise ValueError("sequence length must be positive")
    runs = _session_run(features.select(*KEYS), calendar, length)
    return runs.filter("complete").select(*KEYS)


def panel_rows(
    features: DataFrame,
    labels: DataFrame,
    raw: str,
    target: str,
    eligible: DataFrame | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """Everything of the model panel but the features: one narrow row per feature key.

    The feature keys, both key sets and the labels meet in one aggregate instead
    of a chain of joins, and the wide feature rows are not touched.
    """
    sides = {"feature": features.select(*KEYS), "label": labels.select(*KEYS, number(F.col(raw)).alias("_raw"))}
    sides |= {name: side.select(*KEYS) for name, side in (("eligible", eligible), ("history", history)) if side is not None}
    stacked = None
    for name, side in sides.items():
        part = side.select(*KEYS, F.lit(name).alias("_side"), "_raw" if name == "label" else F.lit(None).cast("double").alias("_raw"))
        stacked = part if stacked is None else stacked.unionByName(part)
    counts = [F.count_if(F.col("_side") == name).alias(f"_{name}") for name in sides]
    rows = stacked.groupBy(*KEYS).agg(*counts, F.max("_raw").alias("_value"))
    repeated = F.greatest(*[F.col(f"_{name}") for name in sides]) > 1
    flag = F.lit(True)
    for name in ("eligible", "history"):
        if name in sides:
            flag = flag & (F.col(f"_{name}") > 0)
    flag = F.when(repeated, F.raise_error(F.lit("panel inputs contain duplicate keys")).cast("boolean")).otherwise(flag)
    rows = rows.filter(F.col("_feature") > 0)
    narrow = stage(rows.select(*KEYS, F.col("_value").alias(raw), flag.alias("is_eligible")))
    scored = zscore_by_date(
        narrow, raw, target, profile=profile_groups(narrow, ["Date"]), where=F.col("is_eligible")
    )
    return scored.select(
        *KEYS,
        target,
        raw,
        "is_eligible",
        (F.col("is_eligible") & F.coalesce(is_finite(F.col(target)), F.lit(False))).alias("is_scoreable"),
    )


def prepare_model_panel(
    features: DataFrame,
    labels: DataFrame,
    names: Sequence[str],
    raw: str,
    target: str,
    eligible: DataFrame | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """Model panel: features (missing -> 0), re-standardised target, raw return, two flags.

    The wide rows are joined once, at the end.
    """
    rows = panel_rows(features, labels, raw, target, eligible, history)
    filled = [f"CAST(coalesce(CASE WHEN abs({name}) < double('inf') THEN {name} END, 0) AS FLOAT) AS {name}" for name in names]
    wide = features.selectExpr(*KEYS, *filled)
    return wide.join(rows, list(KEYS)).select(*KEYS, *names, target, raw, "is_eligible", "is_scoreable")


def split_samples(panel: DataFrame, roles: DataFrame, fold: str, split: str) -> DataFrame:
    """Rows of one fold and split: scoreable for training and validation, eligible for test.

    Test rows need no outcome.
    """
    flag = "is_eligible" if split == "test" else "is_scoreable"
    dates = active_split_dates(roles, fold, split)  # one row per trading day
    return panel.filter(flag).join(F.broadcast(dates), "Date", "left_semi").select(*panel.columns)


def missing_history(targets: DataFrame, sequences: DataFrame) -> DataFrame:
    """Requested keys without a complete sequence."""
    return targets.select(*KEYS).join(sequences.select(*KEYS), list(KEYS), "left_anti")


def sequence_windows(
    panel: DataFrame,
    names: Sequence[str],
    calendar: DataFrame | None = None,
    length: int = SEQUENCE_LENGTH,
    targets: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per target row the FLOAT feature vectors of *length* consecutive sessions, oldest first.

    The calendar defaults to the dates of the panel.  With *targets*, a requested
    key without a full history is an error.
    """
    calendar = calendar if calendar is not None else panel.select("Date")
    vector = F.array(*[F.col(name).cast("float") for name in names])
    runs = _session_run(panel.select(*KEYS, *keep, vector.alias("_vector")), calendar, length)
    window = Window.partitionBy("Code").orderBy("Date").rowsBetween(1 - length, 0)
    windows = runs.withColumn("sequence", F.collect_list("_vector").over(window)).filter("complete")
    windows = windows.select(*KEYS, *keep, "sequence")
    if targets is not None:
        require_empty(missing_history(targets, windows), f"requested rows lack a complete {length}-session history")
        windows = windows.join(targets.select(*KEYS), list(KEYS), "left_semi")
    return windows


def feature_vectors(panel: DataFrame, names: Sequence[str], target: str | None = None, raw: str | None = None) -> DataFrame:
    """Keys, a dense ``features`` vector, and optionally target and raw return."""
    from pyspark.ml.feature import VectorAssembler

    kept = [name for name in (target, raw) if name is not None]
    numeric = panel.select(*KEYS, *kept, *[finite(F.col(name).cast("double")).alias(name) for name in names])
    assembled = VectorAssembler(inputCols=list(names), outputCol="features").transform(numeric.fillna(0.0, list(names)))
    return assembled.select(*KEYS, "features", *kept)
