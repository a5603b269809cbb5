"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams it holds (present or not).  The model is learned from at most
``max_fit`` labelled training rows (the smallest hashes of their ids), so no other text is moved.  Their document
counts per label give each n-gram the ratio log((c1 / C1) / (c0 / C0)); n-grams in at least ``min_count`` rows
whose shares differ much (|ratio| >= ``min_ratio``) and clearly (|z| >= ``min_z``) stay, however many they are.  The
sample is bounded, so no test changes with the size of the table.  A ridge logistic model on the ratios, fitted on the sparse rows of the
sample, gives the score.  Only texts and labels of the training rows are seen by the model.

Defined cases: NULL text counts as empty; an empty text gets the score of the intercept; NULL
labels are no labels; without both labels the score is the smoothed rate; repeated rows score
alike and rows that agree in id and text are learned once; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import fixed_lists, ship, text_bytes, with_columns
from panelwright.session import stage

ship(__name__)

NGRAMS = (4, 5, 6)
BUCKETS = 1 << 18
MIN_Z = 4.0
MIN_COUNT = 5
MIN_RATIO = 1.0
MAX_FIT = 15_000
TASKS = 4
RIDGE = 1.0


def ngram_buckets(text: bytes, sizes: Sequence[int], buckets: int) -> np.ndarray:
    """The bucket of every n-gram of the lower-cased text, white space kept as one blank each."""
    text = b" " + b" ".join(text.lower().split()) + b" "
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    parts, key = [], np.zeros(len(x), np.uint64)
    for n in range(1, max(sizes) + 1):
        if n > len(x):
            break
        key = key[: len(x) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + x[n - 1 :]
        if n in sizes:
            mixed = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            parts.append((mixed >> shift).astype(np.int64))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def label_counts(rows: DataFrame, sizes: Sequence[int] = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """Document counts per bucket and label from columns ``text`` and ``y``; bucket -1 counts documents.

    Each task adds up two arrays of fixed size and emits its non-zero cells once.
    """
    def run(batches):
        counts = np.zeros((2, buckets), np.int64)
        totals = np.zeros(2, np.int64)
        for batch in batches:
            for text, y in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                counts[y, np.unique(ngram_buckets(text, sizes, buckets))] += 1
                totals[y] += 1
        used = np.flatnonzero(counts.sum(0))
        for at in range(0, len(used), 10_000):
            part = used[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0, part]), pa.array(counts[1, part])], names=["bucket", "c0", "c1"])
        if totals.any():
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array(totals[:1]), pa.array(totals[1:])], names=["bucket", "c0", "c1"])

    # few tasks, since each may hand on as many cells as there are buckets
    parts = rows.select("text", F.col("y").cast("int").alias("y")).coalesce(TASKS).mapInArrow(run, "bucket long, c0 long, c1 long")
    return parts.groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _present(weight_of: np.ndarray, sizes: Sequence[int]):
    """Kernel: the sorted selected features that each text holds."""
    def kernel(texts):
        rows = []
        for text in texts:
            found = weight_of[ngram_buckets(text, sizes, len(weight_of))]
            rows.append(np.unique(found[found >= 0]))
        return [fixed_lists(rows, pa.int32())]

    return kernel


def ratios(c0: np.ndarray, c1: np.ndarray, n0: float, n1: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of each n-gram, and the z of the difference of its two shares."""
    a, b = (c1 + 1) / (n1 + 2), (c0 + 1) / (n0 + 2)
    both = (c0 + c1 + 2) / (n0 + n1 + 4)
    spread = np.sqrt(np.maximum(both * (1 - both) * (1 / (n1 + 2) + 1 / (n0 + 2)), 1e-12))
    return np.log(a / b), (a - b) / spread


class Sparse:
    """Rows that hold the places between two ends, each place with its value; four bytes an entry.

    Products with vectors go over blocks of rows, so that what they need beside is small.
    """

    def __init__(self, places: np.ndarray, ends: np.ndarray, values: np.ndarray, block: int = 500):
        self.places, self.ends, self.values, self.block = places, ends, values, block
        self.shape = len(ends) - 1, len(values)

    def _blocks(self):
        for at in range(0, self.shape[0], self.block):
            ends = self.ends[at : at + self.block + 1]
            yield slice(at, at + len(ends) - 1), np.repeat(np.arange(len(ends) - 1), np.diff(ends)), self.places[ends[0] : ends[-1]]

    def times(self, v: np.ndarray) -> np.ndarray:
        v, out = self.values * v, np.zeros(self.shape[0])
        for rows, row, place in self._blocks():
            out[rows] = np.bincount(row, v[place], rows.stop - rows.start)
        return out

    def turned(self, u: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[1])
        for rows, row, place in self._blocks():
            out += np.bincount(place, u[rows][row], self.shape[1])
        return out * self.values


def fit_sparse(x: Sparse, y: np.ndarray, ridge: float, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each solved with conjugate gradients; the intercept comes last.

    Without both labels all weights are zero but the intercept, the smoothed log-odds of the label.
    """
    n, k = x.shape
    w = np.zeros(k + 1)
    w[-1] = np.log((y.sum() + 1.0) / (n - y.sum() + 1.0))
    if n == 0 or y.min() == y.max():
        return w
    penalty = np.r_[np.full(k, ridge), 1e-6]
    times = lambda v: x.times(v[:-1]) + v[-1]
    turned = lambda u: np.r_[x.turned(u), u.sum()]
    loss = lambda z, v: np.logaddexp(0, z).sum() - z @ y + 0.5 * (penalty * v * v).sum()
    z = times(w)
    now = loss(z, w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        slope = turned(p - y) + penalty * w
        curve = np.maximum(p * (1 - p), 1e-9)
        step, rest = np.zeros(k + 1), slope.copy()
        way, size = rest.copy(), rest @ rest
        for _ in range(200):
            if size <= 1e-6 * (slope @ slope):
                break
            bent = turned(curve * times(way)) + penalty * way
            go = size / (way @ bent)
            step, rest = step + go * way, rest - go * bent
            size, before = rest @ rest, size
            way = rest + size / before * way
        go, change = 1.0, times(step)
        while go > 1e-4 and loss(z - go * change, w - go * step) > now:
            go /= 2
        w, z, before = w - go * step, z - go * change, now
        now = loss(z, w)
        if before - now < 1e-7 * max(1.0, abs(now)):
            break
    return w


def labelled(train: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, max_fit: int) -> DataFrame:
    """__id, y, text of at most ``max_fit`` labelled rows, staged; ids are chosen first, so only their texts move."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1) AND __id IS NOT NULL").distinct()
    texts = train.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    first = F.xxhash64("__id"), F.col("__id"), F.col("y")
    picked = stage(known.join(texts.select("__id"), "__id", "left_semi").orderBy(*first).limit(max_fit))
    own = texts.join(F.broadcast(picked), "__id").withColumn("h", F.xxhash64("text"))  # bounded by max_fit
    few = stage(own.select("__id", "y", "h").distinct().orderBy(*first, "h").limit(max_fit))  # an id may have many texts
    own = own.join(F.broadcast(few), ["__id", "y", "h"], "left_semi")
    return stage(own.groupBy("__id", "y", "h").agg(F.first("text").alias("text")).select("__id", "y", "text"))


def fit(train: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
        sizes: Sequence[int] = NGRAMS, buckets: int = BUCKETS, min_z: float = MIN_Z, min_count: int = MIN_COUNT, min_ratio: float = MIN_RATIO,
        max_fit: int = MAX_FIT, ridge: float = RIDGE) -> dict:
    """The model: selected buckets, their weights (ratio times coefficient) and the intercept."""
    sample = labelled(train, labels, text_col, id_col, label_col, max_fit)
    counts = label_counts(sample, sizes, buckets).toPandas()  # at most buckets + 1 rows
    total = counts[counts.bucket < 0][["c0", "c1"]].sum()
    counts = counts[counts.bucket >= 0].sort_values("bucket")
    c0, c1 = counts.c0.to_numpy(float), counts.c1.to_numpy(float)
    ratio, z = ratios(c0, c1, total.c0, total.c1)
    clear = (np.abs(z) >= min_z) & (np.abs(ratio) >= min_ratio) & (c0 + c1 >= min_count)
    chosen, ratio = counts.bucket.to_numpy(np.int64)[clear], ratio[clear]
    place = np.full(buckets, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    found = with_columns(sample, "text", _present(place, sizes), [("found", T.ArrayType(T.IntegerType()))], ["__id", "y"])
    rows = found.select("y", "found").toArrow()  # at most max_fit rows of chosen n-grams
    y, lists = rows["y"].to_numpy().astype(float), rows["found"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    w = fit_sparse(Sparse(lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())], ratio), y, ridge)
    return {"buckets": buckets, "sizes": tuple(sizes), "chosen": chosen, "weights": w[:-1] * ratio, "intercept": float(w[-1])}


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and ``score``, the probability of the label."""
    place = np.full(model["buckets"], -1, np.int32)
    place[model["chosen"]] = np.arange(len(model["chosen"]))
    present, weights, intercept = _present(place, model["sizes"]), np.asarray(model["weights"]), model["intercept"]

    def kernel(texts):
        rows = present(texts)[0]
        ends, flat = rows.offsets.to_numpy(), rows.flatten().to_numpy()
        sums = np.concatenate([[0.0], np.cumsum(weights[flat])])
        odds = np.clip(intercept + sums[ends[1:]] - sums[ends[:-1]], -35, 35)
        return [1 / (1 + np.exp(-odds))]

    return with_columns(docs, text_col, kernel, [("score", T.DoubleType())], keep)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Fit on rows whose crc32 of the id modulo 3 is not 1, score all: doc_id, held_out, score, predicted."""
    rest = F.crc32(F.col(id_col).cast("string")) % 3
    model = fit(docs.filter(rest != 1), labels.filter(rest != 1), text_col, id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__body"))
    rows = score(rows, model, "__body", ["doc_id"])
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
