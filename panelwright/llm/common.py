"""Helpers shared by the corpus operators.

Kernels run inside tasks on Arrow batches.  Their modules register themselves to be pickled by
value, so executors need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
#: What the operators call a word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Pickle the functions of a module by value when Spark sends them to its workers."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; NULL becomes the empty text."""
    return [b"" if value is None else value for value in column.cast(pa.large_binary()).to_pylist()]


def with_columns(
    frame: DataFrame, text_col: str, kernel: Callable[[list[bytes]], list], fields: Sequence[tuple[str, T.DataType]],
    keep: Sequence[str] | None = None, inside: str | None = None,
) -> DataFrame:
    """Append columns that ``kernel`` derives from the UTF-8 bytes of a block of texts.

    All columns of the frame stay (or those in ``keep``); ``kernel`` returns one sequence per
    field.  With ``inside`` the texts are that field of the struct column ``text_col``, which is not sent
    twice.  A kernel sees blocks of at most ``BLOCK_ROWS`` texts, or about ``BLOCK_BYTES``.
    """
    keep = list(frame.columns if keep is None else keep)
    if not set(keep).isdisjoint(name for name, _ in fields):
        raise ValueError("a derived column would repeat a name of the frame")
    schema = T.StructType([frame.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])
    names = [n for n, _ in fields]

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                if inside is None:
                    texts, columns = part.column(part.num_columns - 1), part.columns[:-1]
                else:
                    texts, columns = part.column(keep.index(text_col)).field(inside), part.columns
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in kernel(text_bytes(texts))]
                yield pa.RecordBatch.from_arrays(columns + arrays, names=keep + names)
        pa.default_memory_pool().release_unused()  # the worker lives on

    if inside is not None:
        return frame.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
    return frame.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded size (an empty batch is one slice)."""
    rows = max(1, min(BLOCK_ROWS, batch.num_rows * BLOCK_BYTES // max(1, batch.nbytes)))
    for at in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(at, rows)


def row_of(frame: DataFrame) -> Column:
    """The whole row as one struct column ``row``, out of the way of names that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("row")


def unpacked(names: Sequence[str], **changed: Column) -> list[Column]:
    """The columns of a packed row again, some of them changed."""
    return [changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in names]


def byte_counts(data: bytes) -> np.ndarray:
    """How often each byte value occurs."""
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def fixed_lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Rows of numbers as an Arrow list column."""
    flat = np.concatenate(rows) if rows else np.zeros(0)
    ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; the last weight is the unpenalised intercept.

    Meant for the bounded sample that a caller collects.  Without both labels all weights are
    zero but the intercept, which is the smoothed log-odds of the label.
    """
    n = len(y)
    x = np.concatenate([x.reshape(n, -1), np.ones((n, 1))], axis=1)
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 1.0) / (n - y.sum() + 1.0))
    if n == 0 or y.min() == y.max():
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(v):
        z = x @ v
        return np.logaddexp(0, z).sum() - z @ y + 0.5 * (penalty * v * v).sum()

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w, before = w - size * step, now
        now = loss(w)
        if before - now < 1e-7 * max(1.0, abs(now)):
            break
    return w
