"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Index: every vector, less the mean vector, is turned by a random orthogonal matrix; the signs of
the turned unit vector are its packed code, and two scalars correct the estimate: the length
|r| of the difference and a = <code / sqrt(D), turned unit vector>.  For a query q,

    <q, x>  ~  <q, mean> + |r| * <turned q, code / sqrt(D)> / a

with an error of at most ``bound`` standard widths |r| |q| sqrt((1 - a^2) / (a^2 (D - 1))).
Search: per block of codes and block of queries, the k-th best lower bound is a threshold; the
vectors whose upper bound reaches it are reranked with exact double-precision products, and the
best k of all blocks win (ties to the smaller id).  Every vector's code is looked at; the queries
are a stated set, so blocks of queries meet blocks of codes.

Index blocks hold at most ``block`` rows, query blocks about ``query_block``; a task looks at one
pair at a time and carries only the best k of its queries on.

Defined cases: vectors that are NULL, all zero, hold NULL or non-finite components, or have
another length than most vectors (ties: the shorter) take no part, as do NULL ids; a repeated id
is searched once, with its smallest vector, and its rows are never its own candidates but are
separate candidates of others; with fewer candidates than k all are returned; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import ship
from panelwright.session import stage

ship(__name__)

K = 20
BOUND = 3.5
BLOCK = 2048
QUERY_BLOCK = 512
SEED = 11


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """The vectors that take part, as (vec_id, vector of doubles), and their length."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("vector")).filter(
        "vec_id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) "
        "AND exists(vector, x -> x <> 0)"
    )
    head = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = head.n if head else 0
    return rows.filter(F.size("vector") == size), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def index(rows: DataFrame, size: int, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Blocks of the index: ids, vectors, packed codes, lengths and corrections as binary arrays."""
    means = rows.agg(*[F.avg(F.col("vector")[i]).alias(f"m{i}") for i in range(size)]).first() if size else []
    centre = np.array([m or 0.0 for m in means], float)

    def run(batches):
        turn = rotation(size, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = _matrix(part.column(1), size)
                r = (x - centre) @ turn.T
                length = np.sqrt((r * r).sum(1))
                fix = np.abs(r).sum(1) / np.sqrt(size) / np.where(length > 0, length, 1)
                codes = np.packbits(r >= 0, axis=1)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.tobytes()], pa.binary()) for a in (ids, x.astype("<f8"), codes, length, np.where(length > 0, fix, 1.0))],
                    names=["ids", "vectors", "codes", "lengths", "fixes"],
                )

    schema = "ids binary, vectors binary, codes binary, lengths binary, fixes binary"
    return stage(rows.select(F.col("vec_id").cast("long"), "vector").mapInArrow(run, schema).withColumn("centre", F.lit(centre.tobytes())))


def search_block(ids, x, codes, length, fix, centre, query_ids, q, k: int, bound: float, seed: int) -> list[tuple[int, int, float]]:
    """The best k of one index block for each query of a block."""
    size = x.shape[1]
    turned = q @ rotation(size, seed).T
    signs = np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1
    near = (turned.astype(np.float32) @ signs.T).astype(float) / np.sqrt(size)
    middle = (q @ centre)[:, None] + near * (length / fix)
    slack = np.sqrt(np.maximum(0.0, 1 - fix * fix) / (fix * fix) / max(1, size - 1)) * length * bound
    wide = np.sqrt((q * q).sum(1))[:, None] * slack + 1e-5 * np.abs(middle) + 1e-12
    out = []
    lower, upper = middle - wide, middle + wide
    own = ids[None, :] == query_ids[:, None]
    lower[own], upper[own] = -np.inf, -np.inf
    for i, query in enumerate(query_ids.tolist()):
        low, high = lower[i], upper[i]
        cut = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
        chosen = np.flatnonzero((high >= cut) & (high > -np.inf))
        exact = (x[chosen] * q[i]).sum(1)
        order = np.lexsort((ids[chosen], -exact))[:k]
        out += [(query, int(ids[chosen[j]]), float(exact[j])) for j in order]
    return out


def search(
    vectors: DataFrame, query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
    bound: float = BOUND, block: int = BLOCK, query_block: int = QUERY_BLOCK, seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that ``query`` selects (default: ids divisible by 20)."""
    query = F.col(id_col) % 20 == 0 if query is None else query
    rows, size = usable(vectors, id_col, vector_col)
    asked, _ = usable(vectors.filter(query), id_col, vector_col)
    asked = asked.filter(F.size("vector") == size).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("vector").alias("vector"))
    asked = stage(asked)
    parts = max(1, -(-asked.count() // query_block))
    blocks = index(rows, size, block, seed).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).groupBy("part").agg(
        F.collect_list("vec_id").alias("query_ids"), F.flatten(F.collect_list("vector")).alias("queries"),
    )  # each part has about query_block rows

    def run(batches):
        best: dict[int, list[np.ndarray]] = {}  # of each query block met in this task: the best k so far of each query
        for batch in batches:
            for i in range(batch.num_rows):
                raw = [batch.column(j)[i].as_py() for j in range(6)]
                ids = np.frombuffer(raw[0], "<i8")
                n = len(ids)
                query_ids = batch.column(6)[i].values.to_numpy()
                q = batch.column(7)[i].values.to_numpy().reshape(-1, size)
                found = search_block(
                    ids, np.frombuffer(raw[1], "<f8").reshape(n, size), np.frombuffer(raw[2], np.uint8).reshape(n, -1), np.frombuffer(raw[3]),
                    np.frombuffer(raw[4]), np.frombuffer(raw[5]), query_ids, q, k, bound, seed,
                )
                if not found:
                    continue
                part = batch.column(8)[i].as_py()
                made = [np.array(c, t) for c, t in zip(zip(*found), (np.int64, np.int64, float))]
                if part in best:
                    made = [np.concatenate(x) for x in zip(best[part], made)]
                order = np.lexsort((made[1], -made[2], made[0]))
                made = [c[order] for c in made]
                first = np.flatnonzero(np.r_[True, made[0][1:] != made[0][:-1]])
                place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
                best[part] = [c[place < k] for c in made]
        for columns in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    met = blocks.join(asked, "part").select("ids", "vectors", "codes", "lengths", "fixes", "centre", "query_ids", "queries", "part")
    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
