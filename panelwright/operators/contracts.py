"""Data-quality contracts: each check yields the offending rows and can fail a job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.safe import is_finite
from ..session import stage


class ContractError(ValueError):
    """A frame breaks a declared contract."""


def require_columns(frame: DataFrame, columns: Sequence[str], name: str = "frame") -> None:
    """Schema-only check; starts no job."""
    missing = sorted(set(columns).difference(frame.columns))
    if missing:
        raise ContractError(f"{name} is missing required columns: {missing}")


def require_empty(violations: DataFrame, message: str) -> None:
    """Fail with a few examples when a violation frame has rows (reads at most three)."""
    examples = violations.limit(3).collect()
    if examples:
        raise ContractError(f"{message}: {[row.asDict() for row in examples]}")


def null_keys(frame: DataFrame, keys: Sequence[str] = ("Code", "Date")) -> DataFrame:
    """Rows with a missing key."""
    test = F.lit(False)
    for key in keys:
        test = test | F.col(key).isNull()
    return frame.filter(test)


def duplicate_keys(frame: DataFrame, keys: Sequence[str] = ("Code", "Date")) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def non_finite(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where any of *columns* is NULL, NaN or infinite."""
    test = F.lit(False)
    for column in columns:
        test = test | ~F.coalesce(is_finite(F.col(column).cast("double")), F.lit(False))
    return frame.filter(test)


def key_violations(frame: DataFrame, keys: Sequence[str] = ("Code", "Date")) -> DataFrame:
    """One summary row per kind of key violation: ``check, n_keys, n_rows``.

    A single partial aggregate by key serves both the null and the uniqueness test.
    """
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    counted = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("missing", missing)
    kinds = F.when(F.col("missing"), "null_key").when(F.col("n") > 1, "duplicate_key")
    return (
        counted.withColumn("check", kinds)
        .filter(F.col("check").isNotNull())
        .groupBy("check")
        .agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))
    )


def contract_report(frames: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """``frame, rule, n_keys, n_rows`` of every broken rule; frames that keep all rules give no row.

    Each entry names a frame, its keys and the columns that must be finite.  Rules: no key is missing, none is
    repeated, no listed value is missing or infinite.  One partial aggregate by key serves all three.
    """
    report = None
    for name, (frame, keys, values) in frames.items():
        missing, bad = F.lit(False), F.lit(False)
        for key in keys:
            missing = missing | F.col(key).isNull()
        for value in values:
            bad = bad | ~F.coalesce(is_finite(F.col(value).cast("double")), F.lit(False))
        keyed = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).withColumn("missing", missing)
        rules = {
            "null_key": (F.col("missing"), F.col("n")),
            "duplicate_key": (~F.col("missing") & (F.col("n") > 1), F.col("n")),
            "non_finite": (F.col("bad") > 0, F.col("bad")),
        }
        sums = keyed.agg(*[a for rule, (ok, n) in rules.items() for a in (F.count_if(ok).alias(f"{rule}_k"), F.sum(F.when(ok, n)).alias(f"{rule}_r"))])
        cells = [F.struct(F.lit(rule).alias("rule"), F.col(f"{rule}_k").alias("n_keys"), F.col(f"{rule}_r").alias("n_rows")) for rule in rules]
        part = sums.select(F.explode(F.array(*cells)).alias("c")).select(F.lit(name).alias("frame"), "c.*").filter("n_keys > 0")
        report = part if report is None else report.unionByName(part)
    return report


def require_unique(frame: DataFrame, keys: Sequence[str] = ("Code", "Date"), name: str = "frame") -> None:
    require_empty(duplicate_keys(frame, keys), f"{name} holds duplicates of {list(keys)}")


def require_keys(frame: DataFrame, keys: Sequence[str] = ("Code", "Date"), name: str = "frame") -> None:
    """Keys present, non-null and unique."""
    require_columns(frame, keys, name)
    require_empty(null_keys(frame, keys), f"{name} has null keys or keys that cannot be read")
    require_unique(frame, keys, name)


def checked(value: Column, valid: Column, message: str) -> Column:
    """The value, failing the running job in place where *valid* does not hold."""
    return F.when(F.coalesce(valid, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def row_guard(valid: Column, message: str) -> Column:
    """A filter that keeps every row and fails the running job where *valid* does not hold.

    Unlike :func:`checked` it belongs to no column, so a later select cannot prune it.  Not for
    columns from the optional side of an outer join: the optimizer tries such filters on NULLs.
    """
    return F.when(F.coalesce(valid, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def unique_guard(frame: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """The frame, failing the job where a key occurs twice; one exchange by the keys, or none if it has it already.

    A later select cannot prune the window, since the filter above needs it.
    """
    counted = frame.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.filter(row_guard(F.col("_same") == 1, message)).drop("_same")


def staged(frame: DataFrame, rules: Mapping[str, Column] | None = None, some: Mapping[str, Column] | None = None) -> DataFrame:
    """Stage a frame; the same pass counts the rows that break a rule, and the job fails after the write.

    ``rules`` (message -> condition) must hold for all rows, ``some`` for one row at least.  The counts are
    observed where the rows are written, so no select prunes them, and they may use columns from the
    optional side of an outer join, where a :func:`row_guard` cannot stand.
    """
    rules, some = dict(rules or {}), dict(some or {})
    seen = Observation()
    counts = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"bad{i}") for i, ok in enumerate(rules.values())]
    counts += [F.count_if(F.coalesce(ok, F.lit(False))).alias(f"good{i}") for i, ok in enumerate(some.values())]
    table = stage(frame.observe(seen, F.count(F.lit(1)).alias("rows"), *counts))
    found = seen.get  # empty if the optimizer saw that there are no rows
    broken = [f"{text} ({found[f'bad{i}']} rows)" for i, text in enumerate(rules) if found.get(f"bad{i}", 0)]
    broken += [text for i, text in enumerate(some) if not found.get(f"good{i}", 0)]
    if broken:
        raise ContractError("; ".join(broken))
    return table


def conflicting_entry_dates(roles: DataFrame) -> DataFrame:
    """Entry dates that belong to more than one signal date."""
    return (
        roles.groupBy("entry_date")
        .agg(F.countDistinct("signal_date").alias("n_signals"))
        .filter(F.col("n_signals") > 1)
    )


def unmapped_dates(panel: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of *panel* whose Date is absent from the one-column *dates*."""
    return panel.join(dates.select("Date"), "Date", "left_anti")
