"""Packing: optimal length buckets, and token-budget batches inside each bucket.

The global histogram of lengths goes through a dynamic program that places the bucket boundaries
with the least padding in total (every document is padded to its bucket's boundary).  Lengths up
to ``EXACT`` have a bin of their own; longer ones share bins of at most 1/128 of their length, so
the histogram is bounded whatever the data; bins keep exact counts, sums and largest lengths.

Inside a bucket, documents are dealt by a hash of their id to slices of about ``slice_docs``
documents (the number of slices follows from the histogram), and each slice is cut into batches of
``budget // boundary`` documents, at most ``max_docs``.  No task numbers a whole bucket; a slice
ends with one batch that may be part full.  A document longer than the budget is a batch alone.

Defined cases: NULL text has length 0; NULL or negative lengths count as 0; documents of length 0
are packed like others; repeated rows are packed each on its own; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import WORD
from panelwright.session import stage

EXACT = 1024
BUCKETS = 12
BUDGET = 16_384
MAX_DOCS = 256
SLICE_DOCS = 1024


def word_count(text: Column) -> Column:
    """Words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Boundaries with the least padding for bins in ascending order of (largest) length."""
    m = len(lengths)
    if m == 0:
        return []
    n, s = np.concatenate([[0.0], np.cumsum(counts)]), np.concatenate([[0.0], np.cumsum(sums)])
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    back = []
    for _ in range(min(buckets, m)):
        made, last = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        made[0] = 0.0
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
            last[j] = int(cost.argmin())
            made[j] = cost[last[j]]
        best = made
        back.append(last)
    cuts, j = [], m
    for last in reversed(back):
        if j == 0:
            break
        cuts.append(int(lengths[j - 1]))
        j = int(last[j])
    return cuts[::-1]


def length_bins(rows: DataFrame) -> DataFrame:
    """The histogram of ``n_tokens``: largest length, documents and sum of each bin."""
    width = F.expr(f"CASE WHEN n_tokens <= {EXACT} THEN 1L ELSE shiftleft(1L, cast(floor(log2(n_tokens)) AS INT) - 7) END")
    return rows.groupBy(F.ceil(F.col("n_tokens") / width) * width).agg(
        F.max("n_tokens").alias("length"), F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("total"),
    ).select("length", "docs", "total")


def pack(
    docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", budget: int = BUDGET,
    buckets: int = BUCKETS, max_docs: int = MAX_DOCS, slice_docs: int = SLICE_DOCS,
) -> DataFrame:
    """Per document: doc_id, n_tokens, bucket, bucket_length, batch, position, batch_docs, padding.

    ``length`` is any length column (default: words of the text).
    """
    size = word_count(F.col(text_col)) if length is None else F.greatest(F.lit(0), F.coalesce(length, F.lit(0))).cast("long")
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), size.alias("n_tokens")))
    bins = length_bins(rows).toPandas().sort_values("length")  # bounded, see above
    cuts = boundaries(bins.length.to_numpy(float), bins.docs.to_numpy(float), bins.total.to_numpy(float), buckets) or [0]
    of_bin = np.searchsorted(cuts, bins.length.to_numpy()) if len(bins) else np.zeros(0, np.int64)
    held = np.bincount(of_bin, bins.docs.to_numpy(float), len(cuts)) if len(bins) else np.zeros(len(cuts))
    room = [max(1, min(max_docs, budget // cut if cut else max_docs)) for cut in cuts]
    slices = [max(1, -(-int(n) // slice_docs)) for n in held]

    def by_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)

    bucket = F.lit(0)
    for cut in cuts[:-1]:
        bucket = bucket + (F.col("n_tokens") > cut).cast("int")
    rows = rows.withColumn("bucket", bucket).withColumn("slice", F.pmod(F.xxhash64("doc_id"), by_bucket(slices)))
    order = Window.partitionBy("bucket", "slice").orderBy(F.xxhash64(F.lit(1), F.col("doc_id")), "doc_id", "n_tokens")
    rows = rows.withColumn("number", F.row_number().over(order) - 1).withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("bucket", "slice")))
    cap, cut = by_bucket(room), by_bucket(cuts)
    part = F.floor(F.col("number") / cap)
    return rows.select(
        "doc_id", "n_tokens", "bucket", cut.alias("bucket_length"), F.concat_ws("-", "bucket", "slice", part).alias("batch"),
        F.pmod(F.col("number"), cap).cast("int").alias("position"), F.least(cap, F.col("members") - part * cap).cast("int").alias("batch_docs"),
        (cut - F.col("n_tokens")).alias("padding"),
    )
