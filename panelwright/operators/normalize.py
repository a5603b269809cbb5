"""Per-date robust normalisation: MAD clip, then z-score."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import NORMALISED_SUFFIX
from ..session import stage
from .contracts import require_columns
from .groups import LOOKUP_ROWS, GroupProfile, profile_groups

# MAD-to-sigma scale, clip width in sigmas, and the minimum of valid values.
MAD_SCALE = 1.4826
CLIP_SIGMAS = 3.0
MIN_VALID = 10

# Executors need numpy and pyarrow, not this package: the kernel travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# One date's block (rows x columns, 4 bytes each) may use this many cells in a task.
BLOCK_CELLS = 64_000_000
#: So many cells are worked on at once: columns go through the kernel in chunks.
CHUNK_CELLS = 1_000_000
BINS = 2048
FEATURE_PREFIXES = ("M30_", "D1_", "EO_")


def feature_columns_of(frame: DataFrame) -> list[str]:
    """Numeric columns named like raw features."""
    numeric = {"float", "double", "int", "bigint", "smallint"}
    return [name for name, kind in frame.dtypes if name.startswith(FEATURE_PREFIXES) and kind in numeric]


class Columns(Sequence):
    """The named columns of a table as arrays, made when they are asked for."""

    def __init__(self, table: pa.Table, names: Sequence[str]):
        self.table, self.names = table, names

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, place):
        if isinstance(place, slice):
            return Columns(self.table, self.names[place])
        if not -len(self) <= place < len(self):
            raise IndexError(place)
        return self.table.column(self.names[place]).to_numpy()


def mad_zscore_block(block: np.ndarray, min_valid: int = MIN_VALID) -> np.ndarray:
    """Normalise the columns of one date's FLOAT block; NaN marks missing, output has none.

    Median, MAD and clip bounds are single precision, moments double.  The scale
    divides by all rows minus one, missing rows included.
    """
    rows = block.shape[0]
    x = np.where(np.isfinite(block), block, np.float32(np.nan)).astype(np.float32, copy=False)
    valid = np.isfinite(x).sum(axis=0)
    columns = np.arange(x.shape[1])

    def middle(values: np.ndarray) -> np.ndarray:
        ordered = np.sort(values, axis=0)  # NaN sorts last
        low, high = np.maximum(valid - 1, 0) // 2, np.minimum(valid // 2, rows - 1)
        return (ordered[low, columns] + ordered[high, columns]) * np.float32(0.5)

    with np.errstate(all="ignore"):
        median = middle(x)
        width = np.float32(CLIP_SIGMAS * MAD_SCALE) * middle(np.abs(x - median))
        x = np.clip(x, median - width, median + width)
        present = np.isfinite(x)
        mean = np.where(present, x, 0.0).sum(axis=0, dtype=np.float64) / np.maximum(valid, 1)
        deviation = np.where(present, x - mean, 0.0)
        scale = np.sqrt((deviation * deviation).sum(axis=0) / max(rows - 1, 1))
        usable = (valid >= min_valid) & np.isfinite(width) & (width > 0) & np.isfinite(scale) & (scale > 0)
        z = np.where(usable, deviation / np.where(usable, scale, 1.0), 0.0)
    return z.astype(np.float32)


def normalised_columns(columns: Sequence[np.ndarray], edges: Sequence[int], min_valid: int = MIN_VALID, cells: int = CHUNK_CELLS) -> Iterator[np.ndarray]:
    """The columns of whole dates (rows between two edges), normalised; what is worked on beside them has *cells* cells.

    Columns do not depend on each other, so chunks of them give the result of the whole block.
    """
    rows = edges[-1]
    width = max(1, cells // max(1, rows))
    for start in range(0, len(columns), width):
        part = columns[start : start + width]
        block = np.empty((rows, len(part)), dtype=np.float32)
        for index, values in enumerate(part):
            block[:, index] = values
        for first, last in zip(edges, edges[1:]):
            block[first:last] = mad_zscore_block(block[first:last], min_valid)
        for index in range(len(part)):
            yield np.ascontiguousarray(block[:, index])


def _block_normalised(frame: DataFrame, columns: Sequence[str], names: Sequence[str], min_valid: int) -> DataFrame:
    """One exchange by Date, then a stream of Arrow batches per partition; a date is a bounded block."""
    columns, names = list(columns), list(names)
    others = [name for name in frame.columns if name not in set(columns)]
    typed = frame.selectExpr(*others, *[f"CAST({name} AS FLOAT) AS {name}" for name in columns])
    kept = [field for field in typed.schema.fields if field.name in set(others)]
    schema = T.StructType(kept + [T.StructField(name, T.FloatType()) for name in names])

    def scored(table: pa.Table) -> pa.RecordBatch:
        dates = table.column("Date").to_numpy()
        edges = [0, *(np.flatnonzero(dates[1:] != dates[:-1]) + 1).tolist(), len(dates)]
        arrays = [table.column(name).combine_chunks() for name in others]
        made = normalised_columns(Columns(table, columns), edges, min_valid)
        arrays += [pa.array(values) for values in made]
        return pa.Table.from_arrays(arrays, names=others + names).combine_chunks().to_batches()[0]

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by Date; the last date of a batch waits for its remaining rows."""
        waiting: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            dates = table.column("Date").to_numpy()
            if waiting and waiting[-1].column("Date")[0].as_py() != dates[0]:
                yield scored(pa.concat_tables(waiting))
                waiting = []
            start = int(np.searchsorted(dates, dates[-1], side="left"))
            if start > 0:
                yield scored(pa.concat_tables([*waiting, table.slice(0, start)]))
                waiting = []
            waiting.append(table.slice(start))
        if waiting:
            yield scored(pa.concat_tables(waiting))

    return typed.repartition("Date").sortWithinPartitions("Date").mapInArrow(normalise, schema)


def _ordered_bin(value: Column) -> Column:
    """Order-preserving coarse bin of any finite value: sign and quarter octaves."""
    octave = F.floor(F.log2(F.abs(value)) * 4) + 4096
    return F.when(value > 0, octave).when(value < 0, -octave).otherwise(F.lit(0)).cast("long")


def exact_median(cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact FLOAT median per key by repeated histogram refinement.

    Every pass pre-aggregates on the map side and orders at most a few thousand
    bins per key, so a key holding most of the table is never gathered.  A pass
    keeps the bins around the two middle ranks and splits them further until each
    holds one distinct value.  *cells* must be re-readable cheaply (staged).
    """
    x = F.col(value).cast("double")
    keys = list(keys)

    def counted(frame: DataFrame, within: Sequence[str], bin_: Column) -> DataFrame:
        return frame.groupBy(*within, bin_.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")
        )

    bins = counted(cells, keys, _ordered_bin(x))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumns({"total": F.sum("n").over(whole), "before": F.coalesce(F.sum("n").over(before), F.lit(0))})
    ranks = F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))
    picked = bins.select(*keys, "n", "lo", "hi", "before", F.posexplode(ranks).alias("which", "rank"))
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    state = picked.filter(inside).select(*keys, "which", "lo", "hi", (F.col("rank") - F.col("before")).alias("rank"))
    state = stage(state)
    done = state.filter("lo = hi")
    open_ = state.filter("lo < hi")
    while not open_.isEmpty():
        fits = open_.count() <= LOOKUP_ROWS
        joined = cells.join(F.broadcast(open_) if fits else open_, keys).filter(x.between(F.col("lo"), F.col("hi")))
        finer = F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)
        split = joined.groupBy(*keys, "which", "rank", finer.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(x).alias("lo2"), F.max(x).alias("hi2")
        )
        earlier = Window.partitionBy(*keys, "which").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        split = split.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter(inside)
        state = stage(
            split.select(
                *keys, "which", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"),
                (F.col("rank") - F.col("before")).alias("rank"),
            )
        )
        done = done.unionByName(state.filter("lo = hi"))
        open_ = state.filter("lo < hi")
    # The two middle values add in single precision, as the block path does.
    ends = done.groupBy(*keys).agg(
        F.min("lo").cast("float").alias("a"), F.max("lo").cast("float").alias("b"), F.count(F.lit(1)).alias("ends")
    )
    return ends.select(*keys, ((F.col("a") + F.col("b")) * F.lit(0.5).cast("float")).cast("float").alias("median"))


def _refined_normalised(frame: DataFrame, columns: Sequence[str], names: Sequence[str], min_valid: int) -> DataFrame:
    """The same result for dates too large for one task: only aggregates and look-ups."""
    others = [name for name in frame.columns if name not in set(columns)]
    x = F.col("x")
    value = F.when(F.abs(x) < F.lit(float("inf")), x)
    array = F.expr("array(" + ", ".join(f"CAST({name} AS FLOAT)" for name in columns) + ")")
    wide = stage(frame.select(*others, F.transform(array, lambda v: F.when(F.abs(v) < float("inf"), v)).alias("xs")))
    keys = ["Date", "pos"]
    cells = wide.select("Date", F.posexplode("xs").alias("pos", "x")).filter(value.isNotNull())

    def fitted(small: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(small) if rows <= LOOKUP_ROWS else small

    medians = stage(exact_median(cells, keys, "x"))
    rows = medians.count()
    spread = cells.join(fitted(medians, rows), keys).select(
        "Date", "pos", F.abs(x - F.col("median")).cast("float").alias("x")
    )
    mads = exact_median(spread, keys, "x").withColumnRenamed("median", "mad")
    width = (F.lit(CLIP_SIGMAS * MAD_SCALE).cast("float") * F.col("mad")).cast("float")
    bounds = medians.join(mads, keys).select(
        *keys,
        width.alias("width"),
        (F.col("median") - width).cast("float").alias("low"),
        (F.col("median") + width).cast("float").alias("high"),
    )
    bounds = stage(bounds)
    clipped = F.greatest(F.col("low"), F.least(F.col("high"), x)).cast("double")
    moments = cells.join(fitted(bounds, rows), keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(clipped).alias("mean"), F.var_pop(clipped).alias("var"),
        F.first("low").alias("low"), F.first("high").alias("high"), F.first("width").alias("width"),
    )
    sizes = wide.groupBy("Date").agg(F.count(F.lit(1)).alias("rows"))
    scale = F.sqrt(F.col("var") * F.col("n") / F.greatest(F.col("rows") - 1, F.lit(1)))
    usable = (F.col("n") >= min_valid) & (F.col("width") > 0) & (F.col("width") < float("inf")) & (scale > 0)
    fit = moments.join(sizes, "Date").filter(usable)
    # One entry per feature of the date: the collected list is as long as the column list at most.
    by_date = fit.groupBy("Date").agg(
        F.map_from_entries(
            F.collect_list(F.struct("pos", F.struct("low", "high", "mean", scale.alias("scale"))))
        ).alias("fit")
    )
    by_date = stage(by_date)
    few = by_date.count() * max(len(columns), 1) <= LOOKUP_ROWS * 8
    joined = wide.join(F.broadcast(by_date) if few else by_date, "Date", "left")

    def standard(v: Column, index: Column) -> Column:
        fit_ = F.try_element_at(F.col("fit"), index)
        bounded = F.greatest(fit_["low"], F.least(fit_["high"], v)).cast("double")
        z = (bounded - fit_["mean"]) / fit_["scale"]
        return F.coalesce(F.when(v.isNotNull() & fit_.isNotNull(), z), F.lit(0.0)).cast("float")

    scored = joined.select(*others, F.transform("xs", standard).alias("zs"))
    return scored.selectExpr(*others, *[f"zs[{index}] AS {name}" for index, name in enumerate(names)])


def mad_zscore(
    frame: DataFrame,
    columns: Sequence[str] | None = None,
    suffix: str = NORMALISED_SUFFIX,
    min_valid: int = MIN_VALID,
    profile: GroupProfile | None = None,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """Normalise feature columns within each Date; other columns are kept.

    Missing values and degenerate columns become 0.  Dates that fit a task's block
    go through one exchange; larger ones through exact distributed refinement.
    """
    columns = list(columns) if columns is not None else feature_columns_of(frame)
    if len(set(columns)) != len(columns):
        raise ValueError("a feature column is named twice")
    if min_valid < 1:
        raise ValueError("min_valid must be positive")
    require_columns(frame, ["Date", *columns], "feature panel")
    suffix = suffix.strip()
    names = [f"{column}_{suffix}" if suffix else column for column in columns]
    largest = max(block_cells // max(len(columns), 1), 1)
    profile = profile or profile_groups(frame, ["Date"])
    if profile.largest <= largest:
        return _block_normalised(frame, columns, names, min_valid)
    # Few dates can be this large (rows / largest of them), so the list of them is short.
    sizes = frame.groupBy("Date").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > largest).select("Date")
    big = stage(sizes)
    regular = frame.join(F.broadcast(big), "Date", "left_anti").select(*frame.columns)
    heavy = frame.join(F.broadcast(big), "Date", "left_semi").select(*frame.columns)
    return _block_normalised(regular, columns, names, min_valid).unionByName(
        _refined_normalised(heavy, columns, names, min_valid)
    )
