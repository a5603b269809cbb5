"""Group statistics and in-group order that survive hot groups.

A window puts one group into one task.  That is the cheapest plan while every
group is small, and the wrong one when a single group holds a large part of the
table.  Operators therefore profile the grouping first (one key-only aggregate)
and pick: windows for small groups; partial aggregates, broadcast look-ups of a
checked size and range-split groups for large ones.  Results are the same.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

# Executors need numpy and pyarrow, not this package: what runs in a task travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW_ROWS = 500_000
LOOKUP_ROWS = 500_000
SAMPLE_ROWS = 8_192


@dataclass(frozen=True)
class GroupProfile:
    """How many groups there are and how many rows the largest one has."""

    groups: int
    largest: int

    @property
    def fits_window(self) -> bool:
        return self.largest <= WINDOW_ROWS

    @property
    def fits_lookup(self) -> bool:
        return self.groups <= LOOKUP_ROWS


def profile_groups(frame: DataFrame, keys: Sequence[str]) -> GroupProfile:
    """One map-side-combined pass over the key columns only."""
    sizes = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest")).first()
    return GroupProfile(int(row["groups"]), int(row["largest"] or 0))


def lookup(frame: DataFrame, small: DataFrame, keys: Sequence[str], fits: bool, how: str = "left") -> DataFrame:
    """Join one-row-per-group values; broadcast only when the checked row count fits.

    Otherwise the hint is left out and adaptive execution splits skewed partitions.
    """
    return frame.join(F.broadcast(small) if fits else small, list(keys), how)


def with_group_stats(
    frame: DataFrame,
    keys: Sequence[str],
    stats: dict[str, Column],
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Add per-group aggregates to every row."""
    profile = profile or profile_groups(frame, keys)
    if profile.fits_window:
        window = Window.partitionBy(*keys)
        return frame.withColumns({name: stat.over(window) for name, stat in stats.items()})
    small = frame.groupBy(*keys).agg(*[stat.alias(name) for name, stat in stats.items()])
    return lookup(frame, small, keys, profile.fits_lookup)


def _split_points(frame: DataFrame, keys: Sequence[str], order: Column, fits: bool) -> DataFrame:
    """Per hot group: ascending split points of the order key, from a hash sample.

    The points only balance the work; any points give the same result.
    """
    sizes = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > WINDOW_ROWS)
    keyed = lookup(frame.select(*keys, order.alias("_key")), sizes, keys, fits, "inner")
    every = F.greatest(F.lit(1), F.floor(F.col("_n") / SAMPLE_ROWS)).cast("long")
    sample = keyed.filter(F.pmod(F.xxhash64("_key"), every) == 0)
    pieces = F.ceil(2 * F.max("_n") / WINDOW_ROWS) + 1
    points = sample.groupBy(*keys).agg(
        F.array_sort(F.collect_set("_key")).alias("_all"), pieces.cast("int").alias("_pieces")
    )
    step = F.greatest(F.lit(1), F.floor(F.size("_all") / F.col("_pieces"))).cast("int")
    return points.select(*keys, F.filter("_all", lambda _, i: i % step == step - 1).alias("_points"))


def with_position(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    output: str,
    profile: GroupProfile | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Add the 1-based position of each row within its group under ascending *order*.

    With *weight*, the position is the running sum of the weight instead.  The
    order must be total within a group.
    """
    profile = profile or profile_groups(frame, keys)
    weight = F.lit(1).cast("long") if weight is None else weight
    if profile.fits_window:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return frame.withColumn(output, F.sum(weight).over(window))

    rows = stage(frame.withColumns({"_order": F.struct(*order), "_weight": weight}))
    points = stage(_split_points(rows, keys, F.col("_order"), profile.fits_lookup))
    # Hot groups only; without a hint, the size of the staged table decides on a broadcast.
    rows = rows.join(points, list(keys), "left")
    below = F.size(F.filter("_points", lambda point: point < F.col("_order")))
    rows = rows.withColumn("_piece", F.coalesce(F.when(F.col("_points").isNotNull(), below), F.lit(0))).drop("_points")
    pieces = rows.groupBy(*keys, "_piece").agg(F.sum("_weight").alias("_in_piece"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumn("_offset", F.coalesce(F.sum("_in_piece").over(before), F.lit(0))).drop("_in_piece")
    offsets = offsets.filter(F.col("_piece") > 0)
    inside = Window.partitionBy(*keys, "_piece").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_inside", F.sum("_weight").over(inside))
    placed = placed.join(offsets, [*keys, "_piece"], "left")
    placed = placed.withColumn(output, F.col("_inside") + F.coalesce("_offset", F.lit(0)))
    return placed.drop("_order", "_weight", "_piece", "_inside", "_offset")


def average_rank(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    output: str,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Add the ascending average-tie rank of *value* within its group (value not NULL)."""
    profile = profile or profile_groups(frame, keys)
    if profile.fits_window:
        return frame.withColumn(output, average_rank_over(keys, F.col(value)))
    # One row per distinct value first, so heavy ties shrink before anything is ordered.
    distinct = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    placed = with_position(distinct, keys, [F.col(value)], "_last", profile, weight=F.col("_ties"))
    ranks = placed.select(*keys, value, (F.col("_last") - (F.col("_ties") - 1) / 2).alias(output))
    return frame.join(ranks, [*keys, value], "left")


def average_rank_over(keys: Sequence[str], value: Column) -> Column:
    """Average-tie rank as one window expression: half-way between first and last tied place.

    Both parts use the same ordering, so they share one sort.
    """
    window = Window.partitionBy(*keys).orderBy(value)
    last = F.count(F.lit(1)).over(window.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (F.rank().over(window) + last) / 2


def average_ranks(values: np.ndarray) -> np.ndarray:
    """Ascending average-tie ranks of one group's values, none of them missing."""
    _, place, ties = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(ties) - (ties - 1) / 2)[place]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by *keys*; the last group of a batch waits for its other rows."""
    waiting: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if waiting and any(waiting[-1].column(key)[-1] != table.column(key)[0] for key in keys):
            yield pa.concat_tables(waiting)
            waiting = []
        start = int(group_edges(table, keys)[-2])
        if start > 0:
            yield pa.concat_tables([*waiting, table.slice(0, start)])
            waiting = []
        waiting.append(table.slice(start))
    if waiting:
        yield pa.concat_tables(waiting)


def group_edges(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where the groups of a table sorted by *keys* begin, and its length."""
    changes = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for key in keys:
        values = table.column(key).combine_chunks()
        differs = pc.fill_null(pc.not_equal(values[1:], values[:-1]), False)
        missing = pc.xor(pc.is_null(values[1:]), pc.is_null(values[:-1]))
        changes |= pc.or_(differs, missing).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(changes) + 1, [table.num_rows]))


def in_order(table: pa.Table, edges: np.ndarray, order: str | None, repeated: str) -> pa.Table:
    """Rows of whole groups in the ascending order of *order* within each group, which may not hold a value twice."""
    if order is None:
        return table
    column = table.column(order).combine_chunks()
    place = pc.sort_indices(column).to_numpy()
    group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    if len(edges) > 2:
        place = place[np.argsort(group[place], kind="stable")]
    ordered, group = column.take(pa.array(place)), group[place]
    same = pc.fill_null(pc.equal(ordered[1:], ordered[:-1]), False).to_numpy(zero_copy_only=False)
    if (same & (group[1:] == group[:-1])).any():
        raise ValueError(repeated)
    return table.take(pa.array(place))


def _numbers(table: pa.Table, names: Sequence[str]) -> list[np.ndarray]:
    return [table.column(name).to_numpy() for name in names]


def by_whole_groups(
    rows: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    reduce: Callable[..., list],
    outputs: Sequence[tuple[str, T.DataType]],
    order: str | None = None,
    repeated: str = "",
    each: tuple[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One output row a group: *reduce* of its value columns (DOUBLE, NULL as NaN), in the ascending order of *order*.

    One exchange and one sort by the keys alone; a group must fit a task (see :func:`profile_groups`).  With *order*,
    rows that repeat a key and that column fail the job with the message *repeated*.  With *each*, a label
    and columns, there is one output row a group and column, and *reduce* gets that column before the others.
    """
    keys, values, names = list(keys), list(values), [name for name, _ in outputs]
    label, columns = ([], [None]) if each is None else ([each[0]], list(each[1]))
    kinds = {field.name: field for field in rows.schema.fields}
    labels = [T.StructField(name, T.StringType()) for name in label]
    schema = T.StructType([kinds[key] for key in keys] + labels + [T.StructField(name, kind) for name, kind in outputs])
    whole = [kind for _, kind in outputs]

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            edges = group_edges(table, keys)
            table = in_order(table, edges, order, repeated)
            firsts = [table.column(key).combine_chunks().take(pa.array(edges[:-1])) for key in keys]
            shared = _numbers(table, values)
            for column in columns:
                arrays = shared if column is None else [*_numbers(table, [column]), *shared]
                found = [reduce(*[array[a:b] for array in arrays]) for a, b in zip(edges, edges[1:])]
                made = [pa.array(part, pa.float64() if kind == T.DoubleType() else pa.int64()) for part, kind in zip(zip(*found), whole)]
                named = [pa.array([column] * len(found), pa.string()) for _ in label]
                yield pa.RecordBatch.from_arrays([*firsts, *named, *made], names=keys + label + names)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(reduced, schema)


def with_group_columns(
    rows: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    make: Callable[..., list],
    outputs: Sequence[str],
    order: str | None = None,
    repeated: str = "",
) -> DataFrame:
    """The rows and DOUBLE columns that *make* derives from the value columns of each whole group.

    Exchange, sort, *order* and *repeated* as in :func:`by_whole_groups`.
    """
    keys, values, outputs = list(keys), list(values), list(outputs)
    schema = T.StructType(rows.schema.fields + [T.StructField(name, T.DoubleType()) for name in outputs])

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            edges = group_edges(table, keys)
            table = in_order(table, edges, order, repeated).combine_chunks()
            arrays = _numbers(table, values)
            found = [make(*[array[a:b] for array in arrays]) for a, b in zip(edges, edges[1:])]
            for name, parts in zip(outputs, zip(*found)):
                table = table.append_column(name, pa.array(np.concatenate(parts)))
            yield from table.to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(widened, schema)
