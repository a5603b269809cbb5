"""Boosted-tree regressors with regularised leaves, stopped by daily IC while they grow (K1-K5).

A round finds the shape of one tree with the library's distributed tree learner on the residuals of a
sample of rows and features, then sets its leaves anew: one grouped sum of the residuals by leaf,
shrunk by the preset's penalties.  The score so far (``_margin``) travels with the rows; after every
few rounds it is written with them, and the validation metrics of a block of rounds decide whether the next
block is fitted at all.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.safe import finite
from ..session import shared_folder, stage, unstage
from .metrics import daily_regression_metrics
from .universe import feature_vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The two tree presets.  featureFraction and rowFraction are drawn anew for every tree.
PRESETS = {
    "lgb": {"stepSize": 0.01, "maxDepth": 8, "minInstancesPerNode": 512, "rowFraction": 0.8, "featureFraction": 0.8,
            "maxBins": 255, "maxIter": 5000, "leafL1": 0.0, "leafL2": 0.0005},
    "xgb": {"stepSize": 0.01, "maxDepth": 8, "minInstancesPerNode": 256, "rowFraction": 0.8, "featureFraction": 0.8,
            "maxBins": 64, "maxIter": 5000, "leafL1": 0.0, "leafL2": 1.0},
}
PATIENCE = 50
#: Rounds between two looks at the validation metrics (and two writes of the validation rows' scores).
BLOCK = 16
#: Rounds between two writes of the training rows' scores: planning a round takes as long as the trees that it brings forward.
CARRY = 4
SAMPLE = 10_000


def tree_params(preset: str, **overrides: object) -> dict[str, object]:
    if preset not in PRESETS:
        raise ValueError(f"no tree preset named {preset!r}; there are {sorted(PRESETS)}")
    unknown = set(overrides) - set(PRESETS[preset])
    if unknown:
        raise ValueError(f"tree presets have no {sorted(unknown)}")
    return PRESETS[preset] | overrides


# ---- trees ----------------------------------------------------------------------------------------------------
@dataclass
class Tree:
    """Nodes in the order of a walk that takes left children first; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    @property
    def leaves(self) -> np.ndarray:
        """Node numbers of the leaves, left to right: the learner numbers leaves in this order."""
        return np.flatnonzero(self.left == np.arange(len(self.left)))


_SPLIT = re.compile(r"\s*If \(feature (\d+) <= (\S+)\)")
_LEAF = re.compile(r"\s*Predict: (\S+)")


def read_tree(model: DecisionTreeRegressionModel, chosen: Sequence[int]) -> Tree:
    """The shape of a fitted tree, from its printed form; ``chosen`` are the features it was shown."""
    nodes: list[list] = []
    depth = 0

    def grow(lines, level: int) -> int:
        nonlocal depth
        here, line = len(nodes), next(lines)
        if split := _SPLIT.match(line):
            nodes.append([chosen[int(split[1])], float(split[2]), 0, 0, 0.0])
            nodes[here][2] = grow(lines, level + 1)
            next(lines)  # Else
            nodes[here][3] = grow(lines, level + 1)
        else:
            depth = max(depth, level)
            nodes.append([0, 0.0, here, here, float(_LEAF.match(line)[1])])
        return here

    grow(iter(model.toDebugString.splitlines()[1:]), 0)
    columns = list(zip(*nodes))
    kinds = (np.int32, float, np.int32, np.int32, float)
    return Tree(*[np.array(c, t) for c, t in zip(columns, kinds)], depth)


@dataclass
class Ensemble:
    """start + step * sum of the trees' leaf values.  ``fitted`` counts the trees that training grew."""

    names: list[str]
    start: float
    step: float
    trees: list[Tree] = field(default_factory=list)
    fitted: int = 0

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - the name tree models of the library have
        return len(self.trees)

    @property
    def treeWeights(self) -> list[float]:  # noqa: N802
        return [self.step] * len(self.trees)

    def truncated(self, rounds: int) -> Ensemble:
        """The ensemble of the first *rounds* trees."""
        if not 1 <= rounds <= len(self.trees):
            raise ValueError(f"there are {len(self.trees)} rounds, not {rounds}")
        return replace(self, trees=self.trees[:rounds])

    def running(self, x: np.ndarray, first: int, last: int, score: np.ndarray, only_last: bool = False) -> np.ndarray:
        """Scores after each of the rounds first..last (counted from 1) or only the last of them, given those before."""
        out = np.empty((len(x), 1 if only_last else last - first + 1))
        rows = np.arange(len(x))
        for i in range(first - 1, last):
            tree = self.trees[i]
            node = np.zeros(len(x), np.int32)
            for _ in range(tree.depth):
                node = np.where(x[rows, tree.feature[node]] <= tree.threshold[node], tree.left[node], tree.right[node])
            score = score + self.step * tree.value[node]
            out[:, 0 if only_last else i - first + 1] = score
        return out


def leaf_values(rows: DataFrame, leaf: str, residual: Column | str, l1: float = 0.0, l2: float = 0.0) -> DataFrame:
    """leaf, n, total, value: the residuals' sum by leaf, pulled towards zero by both penalties.

    For squared loss this is the value that minimises the penalised loss of the leaf's rows.
    """
    sums = rows.groupBy(leaf).agg(F.count(F.lit(1)).alias("n"), F.sum(residual).alias("total"))
    pulled = F.signum("total") * F.greatest(F.abs("total") - l1, F.lit(0.0))
    return sums.withColumn("value", F.when(F.col("n") + l2 > 0, pulled / (F.col("n") + l2)).otherwise(0.0))


# ---- growing --------------------------------------------------------------------------------------------------
@dataclass
class _Grown:
    model: DecisionTreeRegressionModel
    chosen: list[int]
    values: list[float]


def _with_leaf(rows: DataFrame, grown: DecisionTreeRegressionModel, chosen: list[int], name: str) -> DataFrame:
    rows = VectorSlicer(inputCol="features", outputCol=f"{name}_x", indices=chosen).transform(rows)
    grown.setFeaturesCol(f"{name}_x").setPredictionCol(f"{name}_p").setLeafCol(name)
    return grown.transform(rows).drop(f"{name}_x", f"{name}_p")


def _with_margin(rows: DataFrame, block: Sequence[_Grown], step: float) -> DataFrame:
    """``_margin`` brought forward by the trees grown since it was written."""
    margin, kept = F.col("_margin"), rows.columns
    for i, tree in enumerate(block):
        rows = _with_leaf(rows, tree.model, tree.chosen, f"_leaf{i}")
        margin = margin + F.lit(step) * F.get(F.lit(tree.values), F.col(f"_leaf{i}").cast("int"))
    return rows.select(*[c for c in kept if c != "_margin"], margin.alias("_margin"))


def _carried(rows: DataFrame, block: Sequence[_Grown], step: float) -> DataFrame:
    """The staged rows written anew with their margin brought forward; the table before it goes."""
    made = stage(_with_margin(rows, block, step))
    unstage(rows)
    return made


def _sampled(rows: DataFrame, fraction: float, seed: int, round_: int) -> DataFrame:
    """A share of the rows, the same however the frame is partitioned."""
    if fraction >= 1:
        return rows
    draw = F.pmod(F.xxhash64("Code", "Date", F.lit(seed), F.lit(round_)), F.lit(SAMPLE))
    return rows.filter(draw < int(round(fraction * SAMPLE)))


def grow_tree(rows: DataFrame, width: int, params: dict, target: str, seed: int, round_: int) -> tuple[_Grown, Tree]:
    """One round on rows with ``features``, the target and ``_margin``."""
    draw = np.random.default_rng([seed, round_])
    count = max(1, int(round(width * params["featureFraction"])))
    chosen = sorted(int(i) for i in draw.choice(width, count, replace=False))
    rows = _sampled(rows, params["rowFraction"], seed, round_).withColumn("_residual", F.col(target).cast("double") - F.col("_margin"))
    shown = VectorSlicer(inputCol="features", outputCol="_shown", indices=chosen).transform(rows)
    learner = RandomForestRegressor(
        featuresCol="_shown", labelCol="_residual", numTrees=1, bootstrap=False, subsamplingRate=1.0, featureSubsetStrategy="all",
        maxDepth=params["maxDepth"], maxBins=params["maxBins"], minInstancesPerNode=params["minInstancesPerNode"], seed=seed + round_,
    )
    # the learner counts, samples and bins its rows in a pass each, and the leaves take another
    shown = shown.select("_shown", "_residual").persist()
    try:
        model = learner.fit(shown).trees[0]
        tree = read_tree(model, chosen)
        placed = model.setFeaturesCol("_shown").setPredictionCol("_p").setLeafCol("_leaf").transform(shown)
        found = leaf_values(placed, "_leaf", "_residual", params["leafL1"], params["leafL2"])
        values = np.zeros(len(tree.leaves))
        for row in found.collect():  # one row a leaf
            values[int(row["_leaf"])] = row["value"]
    finally:
        shown.unpersist()
    tree.value[tree.leaves] = values
    return _Grown(model, chosen, values.tolist()), tree


def boost(
    train: DataFrame, valid: DataFrame, names: Sequence[str], target: str = "target", preset: str = "lgb", patience: int = PATIENCE,
    seed: int = 42, block: int = BLOCK, **overrides: object,
) -> tuple[Ensemble, DataFrame]:
    """Grow rounds until *patience* of them brought no strictly better mean daily validation IC.

    ``train`` and ``valid`` have keys, ``features`` and the target.  At most one block of rounds beyond
    the stop is grown.  Returns the ensemble cut at the best round, and the metrics of all rounds.
    """
    params = tree_params(preset, **overrides)
    shared_folder(train.sparkSession)
    plain = F.col("features").alias("features", metadata={})
    mean = train.agg(F.avg(F.col(target).cast("double"))).first()[0]
    model = Ensemble(list(names), float(mean or 0.0), float(params["stepSize"]))
    sides = [stage(side.select("Code", "Date", plain, target).withColumn("_margin", F.lit(model.start))) for side in (train, valid)]
    history, due = None, []  # trees that the training rows' scores are still without
    while model.fitted < params["maxIter"]:
        first, last = model.fitted + 1, min(model.fitted + block, int(params["maxIter"]))
        grown: list[_Grown] = []
        for round_ in range(first, last + 1):
            if len(due) == CARRY:
                sides[0], due = _carried(sides[0], due, model.step), []
            made, tree = grow_tree(_with_margin(sides[0], due, model.step), len(model.names), params, target, seed, round_)
            grown.append(made)
            due.append(made)
            model.trees.append(tree)
        model.fitted = last
        staged = staged_predictions(model, sides[1], ["Date", target], first, last, "_margin")
        metrics = stage(round_metrics(staged, target))
        history = metrics if history is None else history.unionByName(metrics)
        chosen = best_round(history, patience).first()
        if last - chosen["best_round"] >= patience or last == params["maxIter"]:
            break
        sides[1] = _carried(sides[1], grown, model.step)
    return model.truncated(int(chosen["best_round"])), history


# ---- scoring --------------------------------------------------------------------------------------------------
def staged_predictions(
    model: Ensemble, frame: DataFrame, keep: Sequence[str], first: int = 1, last: int | None = None, offset: str | None = None,
) -> DataFrame:
    """One row per input row and round *first..last* with the running score; ``offset`` holds the score before *first*."""
    last = last or model.getNumTrees
    offset_of = F.col(offset) if offset else F.lit(model.start)
    return _scored(model, frame, keep, vector_to_array("features"), offset_of, first, last).select(
        *keep, F.posexplode("_running").alias("_at", "prediction")
    ).select(*keep, (F.col("_at") + first).alias("round"), "prediction")


def _scored(model: Ensemble, frame: DataFrame, keep: Sequence[str], features: Column, before: Column, first: int, last: int, only_last: bool = False) -> DataFrame:
    rows = frame.select(*keep, features.alias("_features"), before.cast("double").alias("_before"))
    schema = rows.select(*keep, F.array(F.col("_before")).alias("_running")).schema
    width = len(model.names)
    used = Ensemble(model.names, model.start, model.step, model.trees)

    def run(batches):
        for batch in batches:
            x = batch.column(batch.num_columns - 2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            scores = used.running(x, first, last, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), only_last)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * scores.shape[1])
            running = pa.ListArray.from_arrays(ends, pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 2)] + [running], names=schema.names)

    return rows.mapInArrow(run, schema)


def predict(model: Ensemble, panel: DataFrame, names: Sequence[str], target: str | None = None, raw: str | None = None) -> DataFrame:
    """Keys, the given outcome columns and one score per row of *panel*."""
    if list(names) != model.names:
        raise ValueError("the model was trained on other features")
    kept = ["Code", "Date", *[name for name in (target, raw) if name is not None]]
    features = F.array(*[F.coalesce(finite(F.col(name).cast("double")), F.lit(0.0)) for name in names])
    scored = _scored(model, panel, kept, features, F.lit(model.start), 1, model.getNumTrees, only_last=True)
    return scored.select(*kept, F.col("_running")[0].alias("prediction"))


# ---- rounds ---------------------------------------------------------------------------------------------------
def round_metrics(staged: DataFrame, target: str = "target") -> DataFrame:
    """Mean daily metrics per boosting round; the rows of all rounds collapse map-side and never cross the network."""
    daily = daily_regression_metrics(staged, "prediction", target, ("round", "Date"))
    return daily.groupBy("round").agg(
        F.avg("ic").alias("daily_ic"), F.avg("mse").alias("daily_mse"), F.avg("r2").alias("daily_r2")
    )


def best_round(metrics: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """One row ``best_round, best_ic, last_round``: first strict maximum before patience runs out.

    The window runs over boosting rounds only, one row each.
    """
    order = Window.orderBy("round")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct("daily_ic", -F.col("round"))).over(so_far)
    tracked = metrics.withColumn("best", best).select(
        "round", F.col("best.daily_ic").alias("ic"), (-F.col("best.col2")).alias("at")
    )
    stop = F.min(F.when(F.col("round") - F.col("at") >= patience, F.col("round"))).over(Window.partitionBy())
    kept = tracked.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("round") <= F.col("stop")))
    return kept.agg(
        F.max_by("at", "round").alias("best_round"),
        F.max_by("ic", "round").alias("best_ic"),
        F.max("round").alias("last_round"),
    )


def train_on_panel(
    train: DataFrame, valid: DataFrame, names: Sequence[str], target: str, preset: str = "lgb",
    patience: int = PATIENCE, seed: int = 42, block: int = BLOCK, **overrides: object,
) -> tuple[Ensemble, DataFrame]:
    """Fit on training rows, stop by the validation rows, keep the best round."""
    sides = [feature_vectors(side, names, target) for side in (train, valid)]
    return boost(*sides, names, target, preset, patience, seed, block, **overrides)


# ---- storage --------------------------------------------------------------------------------------------------
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double"


def model_nodes(spark: SparkSession, model: Ensemble) -> DataFrame:
    """The ensemble as a table, one row a node (at most maxIter * 2^(maxDepth + 1) rows)."""
    rows = [
        (t, n, int(tree.feature[n]), float(tree.threshold[n]), int(tree.left[n]), int(tree.right[n]), float(tree.value[n]))
        for t, tree in enumerate(model.trees) for n in range(len(tree.feature))
    ]
    return spark.createDataFrame(rows, NODES)


def save_model(model: Ensemble, path: str) -> None:
    spark = SparkSession.active()
    model_nodes(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    about = [(model.names, model.start, model.step, model.fitted)]
    spark.createDataFrame(about, "names array<string>, start double, step double, fitted int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_model(path: str) -> Ensemble:
    spark = SparkSession.active()
    about = spark.read.parquet(f"{path}/about").first()
    model = Ensemble(list(about["names"]), about["start"], about["step"], fitted=about["fitted"])
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"], kind="stable")
    for _, rows in nodes.groupby("tree", sort=True):
        left, right = rows["left"].to_numpy(np.int32), rows["right"].to_numpy(np.int32)
        level = np.zeros(len(rows), int)
        for n in range(len(rows)):  # children come after their parent
            if left[n] != n:
                level[left[n]] = level[right[n]] = level[n] + 1
        model.trees.append(Tree(rows["feature"].to_numpy(np.int32), rows["threshold"].to_numpy(), left, right, rows["value"].to_numpy(), int(level.max())))
    return model
