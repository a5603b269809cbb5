"""Readers and writers for panels, bars, roles and predictions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contracts import ContractError, require_columns
from ..operators.universe import normalized_keys
from ..registry import FeatureManifest, manifest_of

DATED_FILES = "[0-9]" * 8 + ".parquet"


def _file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1)


def read_csv(spark: SparkSession, path: str, separator: str = ",", schema: T.StructType | str | None = None,
             code_column: str = "Code") -> DataFrame:
    """Delimited text with a header; the code column is always text (leading zeros survive).

    Without a schema the other columns are typed by reading the file once more.
    """
    reader = spark.read.option("header", True).option("sep", separator)
    if schema is not None:
        return reader.schema(schema).csv(path)
    inferred = reader.option("inferSchema", True).csv(path).schema
    fields = [T.StructField(f.name, T.StringType() if f.name == code_column else f.dataType) for f in inferred.fields]
    return reader.schema(T.StructType(fields)).csv(path)


def read_frame(spark: SparkSession, path: str, code_column: str = "Code", schema: T.StructType | str | None = None) -> DataFrame:
    """A table by its suffix: Parquet file or directory, CSV, or tab-separated text."""
    lowered = path.rstrip("/").lower()
    if lowered.endswith(".csv"):
        return read_csv(spark, path, ",", schema, code_column)
    if lowered.endswith((".tsv", ".txt")):
        return read_csv(spark, path, "\t", schema, code_column)
    name = lowered.rsplit("/", 1)[-1]
    if "." in name and not lowered.endswith((".parquet", ".pq")):
        raise ValueError(f"unsupported table: {path}")
    return spark.read.parquet(path)


def _with_stem(frame: DataFrame, column: str) -> DataFrame:
    present = {name.lower() for name in frame.columns}
    return frame if column.lower() in present else frame.withColumn(column, _file_stem())


def read_dated_directory(spark: SparkSession, path: str, date_column: str = "Date") -> DataFrame:
    """Parquet directory; the date comes from the file stem when the files hold none."""
    return _with_stem(spark.read.option("pathGlobFilter", "*.parquet").parquet(path), date_column)


def _names(dates: Iterable[int]) -> str:
    """A path component that matches just these dates."""
    return "{" + ",".join(f"{int(d):08d}" for d in sorted(set(dates))) + "}"


def read_session_tree(spark: SparkSession, root: str, dates: Iterable[int] | None = None) -> DataFrame:
    """Minute bars in a tree ``<YYYYMMDD>/<HHMM>.parquet``; folder and file name give Date and Minute.

    With *dates* only their folders are listed and read.  Without, a later filter on Date still skips the
    files of other folders, since the date is a part of the file's path.  Columns that the files hold win.
    """
    folders = "[0-9]" * 8 if dates is None else _names(dates)
    frame = spark.read.parquet(f"{root.rstrip('/')}/{folders}/*.parquet")
    present = {name.lower() for name in frame.columns}
    if "date" not in present:
        frame = frame.withColumn("Date", F.regexp_extract("_metadata.file_path", r"/([0-9]{8})/[^/]*$", 1).cast("int"))
    return _with_stem(frame, "Minute")


def read_sessions_of(spark: SparkSession, directory: str, dates: Iterable[int]) -> DataFrame:
    """The ``YYYYMMDD.parquet`` files of the given dates; no other file is listed or read."""
    frame = spark.read.parquet(f"{directory.rstrip('/')}/{_names(dates)}.parquet")
    present = {name.lower() for name in frame.columns}
    return frame if "date" in present else frame.withColumn("Date", _file_stem().cast("int"))


def read_daily_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars: delimited text, one Parquet file, or a directory of dated files."""
    if path.rstrip("/").lower().endswith((".csv", ".tsv", ".txt")):
        return read_frame(spark, path)
    return read_dated_directory(spark, path)


def read_minute_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Minute bars: one table, or a directory whose file stems give the minute."""
    if path.rstrip("/").lower().endswith((".csv", ".tsv", ".txt")):
        return read_frame(spark, path)
    return _with_stem(spark.read.parquet(path), "Minute")


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, normalize: bool = False) -> DataFrame:
    """Exactly the requested columns, in order; optionally with normalised keys."""
    frame = spark.read.parquet(path)
    if columns is not None:
        require_columns(frame, columns, path)
        frame = frame.select(*columns)
    return normalized_keys(frame) if normalize else frame


def read_many_parquet(spark: SparkSession, paths: Iterable[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Union of same-shape files; no file at all gives an empty frame with the given columns."""
    paths = list(paths)
    if not paths:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns or ()]))
    frame = spark.read.parquet(*paths)
    if columns is None:
        return frame
    require_columns(frame, columns, "tables")
    return frame.select(*columns)


def list_dated_files(spark: SparkSession, directory: str) -> DataFrame:
    """``Date, path`` of the ``YYYYMMDD.parquet`` files of a directory (names only, no content)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", DATED_FILES).load(directory).select("path")
    return files.select(F.regexp_extract("path", r"([0-9]{8})\.parquet$", 1).cast("int").alias("Date"), "path")


def read_dated_files(spark: SparkSession, directory: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Only the ``YYYYMMDD.parquet`` files, with ``Date`` from the name and an optional range."""
    frame = spark.read.option("pathGlobFilter", DATED_FILES).parquet(directory)
    date = _file_stem().cast("int")
    if first is not None:
        frame = frame.filter(date >= first)
    if last is not None:
        frame = frame.filter(date <= last)
    return frame if "Date" in frame.columns else frame.withColumn("Date", date)


def write_parquet(
    frame: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite", only_own: bool = False
) -> str:
    """Write Parquet; partitioned output is balanced by size first.

    Adaptive execution puts partition values together in tasks until they reach its advisory size and splits
    a value that is larger: a small date is one file, a very large one several, and neither depends on a
    number set here.  With *only_own* the other partition values of the table stay.
    """
    if partition_by:
        frame = frame.hint("rebalance", *partition_by)
    writer = frame.write.mode(mode)
    if only_own:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_report(frame: DataFrame, path: str, order: Sequence[str] = ()) -> str:
    """A small report (summaries, role tables) as one CSV file with a header."""
    ordered = frame.orderBy(*order) if order else frame
    ordered.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_date_roles(spark: SparkSession, path: str) -> DataFrame:
    """Date-role table; text flags and dates are accepted."""
    names = ("fold_id", "split", "signal_date", "entry_date", "exit_date", "purged")
    frame = read_frame(spark, path) if path.lower().endswith((".csv", ".tsv", ".parquet")) else read_csv(spark, path)
    require_columns(frame, names, "date roles")
    dates = ("signal_date", "entry_date", "exit_date")
    return frame.select(*[F.col(n).cast("int").alias(n) if n in dates else F.col(n) for n in names])


def write_predictions(table: DataFrame, root: str, split: str = "test") -> str:
    """Prediction table partitioned by model, fold and split; reruns replace their own partition."""
    frame = table.withColumn("split", F.lit(split))
    (
        frame.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model", "fold", "split")
        .parquet(root)
    )
    return root


def read_model_predictions(spark: SparkSession, root: str, model: str | None = None, split: str = "test") -> DataFrame:
    """All folds of one model (or of every model) as one frame; partitions are pruned."""
    frame = spark.read.parquet(root)
    if "split" in frame.columns:
        frame = frame.filter(F.col("split") == split)
    if model is not None:
        frame = frame.filter(F.col("model") == model)
    return frame


def read_prediction_files(spark: SparkSession, root: str, models: Sequence[str]) -> dict[str, DataFrame]:
    """One ``<model>.parquet`` per model."""
    return {model: spark.read.parquet(f"{root}/{model}.parquet") for model in models}


def load_feature_manifest(spark: SparkSession, protocol: str, path: str | None = None) -> FeatureManifest:
    """Built-in manifest, or a one-column CSV named ``feature`` (a few hundred names)."""
    if path is None:
        return manifest_of(protocol)
    table = spark.read.option("header", True).csv(path)
    if table.columns != ["feature"]:
        raise ContractError(f"manifest must have exactly one column 'feature', got {table.columns}")
    names = [row.feature for row in table.collect()]
    if any(name is None for name in names):
        raise ContractError("manifest contains null feature names")
    return manifest_of(protocol, names)
