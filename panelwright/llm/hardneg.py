"""Hard negatives by Fagin's threshold algorithm over sorted candidate lists.

A row is an integer vector with a label.  For every anchor the best rows of its own label are its
positives; each positive opens a window of scores, and the best rows of other labels whose score
lies in the window are its negatives.  Scores are integer inner products with the anchor; higher
scores come first, ties go to the smaller id.

Candidates are dealt into blocks by a hash of their id.  A block keeps, beside its vectors, one list
of its rows per dimension, sorted by that component.  A group of anchors walks these lists by sorted
access from the end that the anchors' signs ask for (from the top where a component of the anchor is
positive, from the bottom where it is negative); every row met is scored once by random access.  At
depth t no unmet row can score above the threshold

    sum over dimensions of  anchor[d] * (component at depth t of the list of d, from that end)

and a window is done when the threshold lies strictly below its k-th score so far or below its
lower end (strictly: a row with an equal score may have a smaller id).  Windows that are done leave
the walk.  Within a tile the k-th scores found in one block are the start in the next; the best of
all tiles win.  Depths double, so a walk has at most log2(block) steps.  Dense vectors make the
threshold fall slowly: the walk is exact, but there it meets most rows of a block.

Nothing is capped: blocks hold about ``block`` rows, groups about ``group`` anchors, and a task holds
the few blocks of a tile and one group at a time.

Defined cases: rows with a NULL id or label, a NULL vector or a NULL or non-finite component, and rows
whose vector is shorter or longer than most (ties: the shorter) take no part; a repeated id counts
once, with its smallest (label, vector); anchors without another row of their label give no rows,
windows without a row inside give none (a negative positive score makes an empty window); fewer rows
than asked for are returned whole; an empty table gives an empty table; other columns are ignored.
Components are floor(scale * x); beyond 2^26 in size they fail the job, since scores would not fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import ship
from panelwright.session import stage

ship(__name__)

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
BLOCK, GROUP = 8192, 512
#: A tile is up to so many blocks, and groups; blocks are put together once there are twice so many tiles.
BAND, SHARE, TILES = 8, 64, 48
FIRST_DEPTH = 16
ANCHORS = ("anchor_ids", "anchor_labels", "a", "of", "tag", "low", "high")
LEAST, MOST = -(1 << 62), 1 << 62


def usable(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: float = SCALE,
) -> tuple[DataFrame, int]:
    """(vec_id, label, x) of the rows that take part, x the integer components, and their length."""
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"),
    ).filter(
        "vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0 "
        "AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    )
    head = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = head.n if head else 0
    big = F.raise_error(F.lit("a component is too large for integer scores"))
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < float(1 << 26), F.floor(x * scale)).otherwise(big.cast("long")))
    rows = rows.filter(F.size("v") == size).withColumn("x", whole)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
    return one.select("vec_id", "r.label", "r.x"), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def index(rows: DataFrame, size: int, blocks: int) -> DataFrame:
    """One row per block: ids, labels, vectors, and for each dimension the rows in order of that component."""

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table["vec_id"].to_numpy()
        first = np.argsort(ids)
        x = _matrix(table["x"].chunk(0), size)[first]
        raw = (ids[first].astype("<i8"), table["label"].to_numpy()[first].astype("<i8"), x.astype("<i4"), np.argsort(x, axis=0, kind="stable").T.astype("<i4"))
        return pa.table({"block": table["block"].slice(0, 1), **{n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(("ids", "labels", "x", "orders"), raw)}})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return stage(dealt.groupBy("block").applyInArrow(build, "block int, ids binary, labels binary, x binary, orders binary"))


def exact_kind(size: int, x: int, a: int) -> type:
    """The fastest number type in which inner products of components up to ``x`` and ``a`` are exact."""
    most = size * x * a
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class Best:
    """The best k (score, id) of each window: higher scores first, then smaller ids."""

    def __init__(self, windows: int, k: int):
        self.k, self.kth = k, np.full(windows, LEAST, np.int64)
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        window, score, ids = (np.concatenate(x) for x in ((self.window, window), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, window))
        window, score, ids = window[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else np.zeros(0, np.int64)
        place = np.arange(len(window)) - np.repeat(first, np.diff(np.r_[first, len(window)]))
        keep = place < self.k
        self.window, self.score, self.id = window[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.kth[window[full]] = score[full]


def walk(
    ids: np.ndarray, labels: np.ndarray, x: np.ndarray, orders: np.ndarray, anchors: tuple, windows: tuple, best: Best, same: bool,
    first_depth: int = FIRST_DEPTH,
) -> int:
    """Bring the rows of one block into ``best``; returns how many rows were scored.

    anchors: ids, labels, vectors; windows: place of the anchor, lowest and highest score.
    """
    anchor_ids, anchor_labels, a = anchors
    of, low, high = windows
    n, size = x.shape
    kind = exact_kind(size, int(np.abs(x).max(initial=0)), int(np.abs(a).max(initial=0)))
    met = np.zeros(n, bool)
    live = np.arange(len(of))
    depth, done, scored = 0, first_depth, 0
    while len(live) and depth < n:
        group, back = np.unique(of[live], return_inverse=True)
        at = a[group]
        to = min(n, done)
        fresh = np.zeros(n, bool)
        for d in range(size):  # sorted access, from the ends that the anchors' signs ask for
            if (at[:, d] > 0).any():
                fresh[orders[d, n - to : n - depth]] = True
            if (at[:, d] < 0).any():
                fresh[orders[d, depth:to]] = True
        fresh &= ~met
        if to == n:
            fresh = ~met  # rows that only anchors' zero components would reach
        rows = np.flatnonzero(fresh)
        met[rows] = True
        depth, done = to, done * 2
        scored += len(rows)
        if len(rows):  # random access
            score = at.astype(kind) @ x[rows].astype(kind).T
            fits = (labels[rows][None, :] == anchor_labels[group][:, None]) == same
            fits &= ids[rows][None, :] != anchor_ids[group][:, None]
            least = np.maximum(low[live], best.kth[live])
            if len(group) == len(live):
                s, ok = score, fits
            else:
                s, ok = score[back], fits[back]
            w, r = np.nonzero(ok & (s >= least[:, None].astype(kind)) & (s <= high[live][:, None].astype(kind)))
            if len(w):
                best.add(live[w], s[w, r].astype(np.int64), ids[rows[r]])
        if depth < n:
            top, bottom = x[orders[:, n - depth], np.arange(size)], x[orders[:, depth - 1], np.arange(size)]
            wide = at.astype(np.int64)
            threshold = (np.maximum(wide, 0) @ top.astype(np.int64) + np.minimum(wide, 0) @ bottom.astype(np.int64))[back]
            live = live[(threshold >= best.kth[live]) & (threshold >= low[live])]
    return scored


def _searched(blocks: DataFrame, count: int, groups: DataFrame, parts: int, size: int, k: int, same: bool, tiles: int = TILES) -> DataFrame:
    """anchor_id, window, vec_id, score: the best k of each window (``groups`` has one row per group of anchors).

    Every group meets every block in a tile of some blocks and some groups, which one task holds.  Rows of both kinds are
    dealt to the tiles; they are not joined, so no side is ever gathered on the driver and no row holds a block and a group.
    """
    band = max(1, min(BAND, count // tiles))
    bands, shares = -(-count // band), -(-parts // SHARE)

    def run(batches):
        held, tile = [], None
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if column["tile"][i].as_py() != tile:
                    held, tile = [], column["tile"][i].as_py()
                if column["part"][i].as_py() is None:
                    ids, labels = (np.frombuffer(column[c][i].as_py(), "<i8") for c in ("ids", "labels"))
                    x = np.frombuffer(column["x"][i].as_py(), "<i4").reshape(-1, size)
                    held.append((ids, labels, x, np.frombuffer(column["orders"][i].as_py(), "<i4").reshape(size, -1)))
                    continue
                anchor_ids, anchor_labels, a, of, tag, low, high = (column[c][i].values.to_numpy(zero_copy_only=False) for c in ANCHORS)
                best = Best(len(of), k)
                for block in held:
                    walk(*block, (anchor_ids, anchor_labels, a.reshape(-1, size)), (of, low, high), best, same)
                columns = anchor_ids[of][best.window], tag[best.window], best.id, best.score
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "window", "vec_id", "score"])

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = blocks.withColumn("share", each(shares)).withColumn("tile", F.floor(F.col("block") / band).cast("int") * shares + F.col("share"))
    dealt = groups.withColumn("band", each(bands)).withColumn("tile", F.col("band") * shares + F.col("part") % shares)
    rows = rows.select("tile", "ids", "labels", "x", "orders").unionByName(dealt.select("tile", "part", *ANCHORS), allowMissingColumns=True)
    rows = rows.repartition(bands * shares, "tile").sortWithinPartitions("tile", F.col("part").asc_nulls_first())  # blocks first
    return rows.mapInArrow(run, "anchor_id long, window long, vec_id long, score long")


def _groups(anchors: DataFrame, windows: DataFrame, parts: int) -> DataFrame:
    """Anchors with their windows (anchor_id, tag, low, high), gathered by part."""
    own = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("tag", "low", "high"))).alias("w"))  # at most ``positives`` each
    rows = anchors.join(own, "anchor_id").withColumn("part", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).cast("int"))
    rows = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("anchor_id", "label", "x", "w"))).alias("g"))  # about ``group`` anchors
    flat = F.flatten(F.transform("g", lambda r, i: F.transform(r["w"], lambda w: F.struct(i.cast("long").alias("of"), w["tag"].alias("tag"), w["low"].alias("low"), w["high"].alias("high")))))
    rows = rows.withColumn("w", flat)
    return rows.select(
        "part", F.col("g.anchor_id").alias("anchor_ids"), F.col("g.label").alias("anchor_labels"), F.flatten("g.x").cast("array<int>").alias("a"), *[F.col(f"w.{c}").alias(c) for c in ("of", "tag", "low", "high")],
    )


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE, block: int = BLOCK, group: int = GROUP,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` selects the anchors by ``vec_id`` (default: ids divisible by 50); a negative's score lies
    between ``low`` and ``high`` per cent of the positive's.
    """
    rows, size = usable(vectors, id_col, vector_col, label, scale)
    rows = stage(rows)
    blocks = max(1, -(-rows.count() // block))
    lists = index(rows, size, blocks)
    anchors = stage(rows.filter(F.col("vec_id") % 50 == 0 if anchor is None else anchor).withColumnRenamed("vec_id", "anchor_id"))
    parts = max(1, -(-anchors.count() // group))
    # positives: one window without bounds for each anchor
    whole = anchors.select("anchor_id", F.lit(0).cast("long").alias("tag"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    near = _first(_searched(lists, blocks, _groups(anchors, whole, parts), parts, size, positives, True), positives, "anchor_id")
    near = stage(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # low * p <= 100 * s <= high * p, as whole numbers; s = ceil(low * p / 100) ... floor(high * p / 100)
    bounds = [F.expr(e) for e in (
        f"-((-positive_score * {low} - pmod(-positive_score * {low}, 100)) div 100)", f"(positive_score * {high} - pmod(positive_score * {high}, 100)) div 100",
    )]
    windows = near.select("anchor_id", F.col("positive_id").alias("tag"), bounds[0].alias("low"), bounds[1].alias("high")).filter("low <= high")
    hard = _first(_searched(lists, blocks, _groups(anchors, windows, parts), parts, size, negatives, False), negatives, "anchor_id", "window")
    hard = hard.select("anchor_id", F.col("window").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(near, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The registered query's twin: all scores of all anchors, by sorting.
SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, embedding::DOUBLE[] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), common AS (
    SELECT len(v) AS n FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
), r AS (
    SELECT vec_id, min({'label': label, 'x': list_transform(v, lambda x: floor(256 * x))}) AS r FROM v WHERE len(v) = (SELECT n FROM common) GROUP BY 1
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.r.label = b.r.label AS same, list_inner_product(a.r.x, b.r.x)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
