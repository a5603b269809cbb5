"""Prediction alignment, outcomes, dependence and the rank ensemble (M1-M6)."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as K
from ..functions.safe import finite, is_finite, strict_number
from ..registry import EIGHT_MODELS
from ..session import compiled
from .contracts import checked, duplicate_keys, require_columns, require_empty, row_guard
from .groups import GroupProfile, average_rank, average_ranks, by_whole_groups, profile_groups, with_group_columns, with_group_stats

# Executors need numpy and pyarrow, not this package: what runs in a task travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ("Date", "Code")


def prediction_keys(frame: DataFrame) -> DataFrame:
    """DATE and code keys; an invalid key fails the job."""
    require_columns(frame, KEYS, "predictions")
    kind = dict(frame.dtypes)["Date"]
    day = F.col("Date")
    if kind in ("int", "bigint"):
        day = K.integer_datetime(day)
    elif kind != "date":
        day = K.normalize_datetime(day)
    keyed = compiled(frame).withColumns({"Date": day, "Code": K.normalize_code(F.col("Code"))})
    known = F.col("Date").isNotNull() & F.col("Code").isNotNull()
    return keyed.filter(row_guard(known, "Date or Code contains missing or invalid values"))


def read_prediction(
    frame: DataFrame, column: str = "prediction", output: str = "score", keep: Sequence[str] = ()
) -> DataFrame:
    """``Date, Code, score`` with normalised keys; a non-finite score fails the job.

    Key uniqueness is enforced where predictions are grouped by key (alignment).
    """
    if output in KEYS:
        raise ValueError("output column must not replace a key column")
    require_columns(frame, (*KEYS, column), "predictions")
    score = F.col(column).cast("double")
    keyed = prediction_keys(frame.select(*keep, *KEYS, column)).select(*keep, *KEYS, score.alias(output))
    return keyed.filter(row_guard(is_finite(F.col(output)), "prediction scores must all be finite"))


def stack_predictions(
    sources: Mapping[str, DataFrame],
    columns: str | Mapping[str, str] = "prediction",
    models: Sequence[str] = EIGHT_MODELS,
) -> DataFrame:
    """Long ``model, Date, Code, score`` of exactly the registered models."""
    if set(sources) != set(models):
        missing, extra = sorted(set(models) - set(sources)), sorted(set(sources) - set(models))
        raise ValueError(f"sources must be exactly the registered models; missing={missing}, extra={extra}")
    stacked = None
    for model in models:
        column = columns if isinstance(columns, str) else columns[model]
        part = read_prediction(sources[model], column).select(F.lit(model).alias("model"), *KEYS, "score")
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def alignment_counts(long: DataFrame, models: Sequence[str] = EIGHT_MODELS) -> DataFrame:
    """Per model: keys missing against the full key set, and repeated keys; only offenders."""
    counts = [F.count_if(F.col("model") == model).alias(model) for model in models]
    keyed = long.groupBy(*KEYS).agg(*counts)
    totals = keyed.select(
        F.explode(F.array(*[F.struct(F.lit(model).alias("model"), F.col(model).alias("n")) for model in models])).alias("m")
    )
    return (
        totals.groupBy("m.model")
        .agg(F.count_if(F.col("m.n") == 0).alias("missing"), F.count_if(F.col("m.n") > 1).alias("repeated"))
        .filter((F.col("missing") > 0) | (F.col("repeated") > 0))
    )


def unpivot_predictions(wide: DataFrame, models: Sequence[str] = EIGHT_MODELS) -> DataFrame:
    """Long ``model, Date, Code, score`` of a table with one score column a model; keys are read once a row, not once a score."""
    require_columns(wide, (*KEYS, *models), "predictions")
    keyed = prediction_keys(wide.select(*KEYS, *[F.col(model).cast("double").alias(model) for model in models]))
    long = keyed.unpivot(list(KEYS), list(models), "model", "score")
    return long.filter(row_guard(is_finite(F.col("score")), "prediction scores must all be finite"))


def align_predictions(
    long: DataFrame, models: Sequence[str] = EIGHT_MODELS, outcomes: DataFrame | None = None, outcome: str = "return"
) -> DataFrame:
    """Wide ``Date, Code, <models>``: one aggregate pivots and proves equal key sets.

    A key lacking a model, or holding one twice, fails the job; nothing is dropped.  With *outcomes* the same
    aggregate adds the realised returns as :func:`attach_outcomes` does, without a join.
    """
    rows, known = long.select(*KEYS, "model", "score", F.lit(False).alias("_real")), []
    if outcomes is not None:
        # An outcome is one more row of its key.
        realised = _realised(outcomes, outcome)
        rows = rows.unionByName(realised.select(*KEYS, F.lit(None).cast("string").alias("model"), F.col(outcome).alias("score"), F.lit(True).alias("_real")))
        known = [F.count_if("_real").alias("_known"), F.max(F.when(F.col("_real"), F.col("score"))).alias("_outcome")]
    wide = rows.groupBy(*KEYS).agg(
        F.count_if(~F.col("_real")).alias("_rows"), *known,
        *[F.max(F.when(F.col("model") == model, F.col("score"))).alias(model) for model in models],
    )
    kept = [*KEYS, *models]
    if outcomes is not None:
        wide = wide.filter(row_guard(F.col("_known") <= 1, DUPLICATE_OUTCOMES)).filter("_rows > 0")
        kept.append(F.col("_outcome").alias(outcome))
    complete = F.col("_rows") == len(models)
    for model in models:
        complete = complete & F.col(model).isNotNull()
    return wide.filter(row_guard(complete, "some keys do not match: a model lacks them or repeats them")).select(*kept)


def align_model_predictions(
    sources: Mapping[str, DataFrame],
    columns: str | Mapping[str, str] = "prediction",
    models: Sequence[str] = EIGHT_MODELS,
) -> DataFrame:
    """Read and align one prediction frame per model."""
    return align_predictions(stack_predictions(sources, columns, models), models)


DUPLICATE_OUTCOMES = "duplicate outcome keys"


def _realised(outcomes: DataFrame, outcome: str) -> DataFrame:
    """Keys and the outcome, NULL where it is not finite."""
    require_columns(outcomes, (*KEYS, outcome), "outcomes")
    value = finite(strict_number(F.col(outcome)))
    return prediction_keys(outcomes.select(*KEYS, outcome)).withColumn(outcome, value)


def attach_outcomes(predictions: DataFrame, outcomes: DataFrame, outcome: str = "return") -> DataFrame:
    """Left-join realised returns; every prediction row stays, non-finite outcomes become NULL."""
    if outcome in predictions.columns:
        raise ValueError(f"predictions already contain {outcome!r}")
    right = _realised(outcomes, outcome)
    # One row per key on the right: a repeated key fails instead of multiplying rows.
    single = F.count(F.lit(1)) == 1
    right = right.groupBy(*KEYS).agg(
        F.when(single, F.max(outcome)).otherwise(F.raise_error(F.lit(DUPLICATE_OUTCOMES)).cast("double")).alias(outcome)
    )
    return prediction_keys(predictions).join(right, list(KEYS), "left")


REPEATED = "the wide panel repeats a key"
FEW = "ranks take two stocks a date"
CONSTANT = "a model is constant on a date"


def _rankable(panel: DataFrame, models: Sequence[str]) -> DataFrame:
    """The wide panel with DOUBLE scores; a missing key or a score that is not finite fails the job."""
    require_columns(panel, (*KEYS, *models), "wide panel")
    panel = panel.withColumns({model: F.col(model).cast("double") for model in models})
    usable = F.col("Date").isNotNull() & (F.coalesce(F.col("Code").cast("string"), F.lit("")) != "")
    panel = panel.filter(row_guard(usable, "a row of the wide panel lacks a key"))
    all_finite = F.lit(True)
    for model in models:
        all_finite = all_finite & is_finite(F.col(model))
    return panel.filter(row_guard(all_finite, "some predictions are missing or not finite"))


def model_ranks(
    panel: DataFrame, models: Sequence[str] = EIGHT_MODELS, profile: GroupProfile | None = None
) -> DataFrame:
    """Centred average-tie ranks of every model within each date (wide), for dates of any size.

    Centred ranks are multiples of one half, so their sums of products are exact.
    """
    panel = _rankable(panel, models)
    profile = profile or profile_groups(panel, ["Date"])
    require_empty(duplicate_keys(panel, KEYS), REPEATED)
    ranked = with_group_stats(panel.select(*KEYS, *models), ["Date"], {"_n": F.count(F.lit(1))}, profile)
    for model in models:
        ranked = average_rank(ranked, ["Date"], model, f"_{model}", profile)
    ranked = ranked.withColumn("_n", checked(F.col("_n"), F.col("_n") >= 2, FEW))
    return ranked.select(*KEYS, "_n", *[(F.col(f"_{model}") - (F.col("_n") + 1) / 2).alias(model) for model in models])


def _centred(scores: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Centred average-tie ranks of one date, a row a model, and their sums of squares."""
    n = len(scores[0])
    if n < 2:
        raise ValueError(FEW)
    ranks = np.stack([average_ranks(column) for column in scores]) - (n + 1) / 2
    squares = (ranks * ranks).sum(axis=1)
    if not (squares > 0).all():
        raise ValueError(CONSTANT)
    return ranks, squares


def _spearman_of_date(pairs: Sequence[tuple[int, int]]):
    """Rank correlations of the numbered pairs of models on one date."""

    def correlations(*scores: np.ndarray) -> list:
        ranks, squares = _centred(scores)
        return [float((ranks[i] * ranks[j]).sum() / np.sqrt(squares[i] * squares[j])) for i, j in pairs]

    return correlations


def _ensemble_of_date(*scores: np.ndarray) -> list:
    """The mean over models of the rank z-scores of one date."""
    ranks, squares = _centred(scores)
    return [(ranks / np.sqrt(squares / (ranks.shape[1] - 1))[:, None]).sum(axis=0) / len(scores)]


def average_daily_spearman(
    panel: DataFrame, models: Sequence[str] = EIGHT_MODELS, profile: GroupProfile | None = None
) -> DataFrame:
    """Long matrix ``model_a, model_b, correlation``: equal-date mean of daily Spearman.

    Dates that fit a task are ranked in NumPy blocks, after one exchange and one sort for all models.
    """
    profile = profile or profile_groups(panel, ["Date"])
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i:]]
    if profile.fits_window:
        places = {model: i for i, model in enumerate(models)}
        reduce = _spearman_of_date([(places[a], places[b]) for a, b in pairs])
        outputs = [(f"{a}|{b}", T.DoubleType()) for a, b in pairs]
        rows = _rankable(panel, models).select(*KEYS, *models)
        daily = by_whole_groups(rows, ["Date"], models, reduce, outputs, "Code", REPEATED)
    else:
        ranks = model_ranks(panel, models, profile)
        sums = ranks.groupBy("Date").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])

        def correlation(a: str, b: str) -> Column:
            spread = F.sqrt(F.col(f"`{a}|{a}`") * F.col(f"`{b}|{b}`"))
            return F.col(f"`{a}|{b}`") / checked(spread, spread > 0, CONSTANT)

        daily = sums.select("Date", *[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    means = daily.agg(*[F.avg(f"`{a}|{b}`").alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a in models:
        for b in models:
            name = f"{a}|{b}" if (a, b) in pairs else f"{b}|{a}"
            cells.append(F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"`{name}`").alias("correlation")))
    return means.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def rank_zscore_ensemble(
    panel: DataFrame,
    models: Sequence[str] = EIGHT_MODELS,
    output: str = "ensemble_score",
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Equal-weight mean over models of the rank z-score within each date."""
    return with_ensemble(panel, models, output, profile).select(*KEYS, output)


def with_ensemble(
    panel: DataFrame,
    models: Sequence[str] = EIGHT_MODELS,
    output: str = "ensemble_score",
    profile: GroupProfile | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Keys, the scores of the models, the columns to keep, and the rank ensemble; small dates are ranked in NumPy blocks."""
    if output in {*KEYS, *models, *keep}:
        raise ValueError("output column collides with an input column")
    profile = profile or profile_groups(panel, ["Date"])
    if profile.fits_window:
        rows = _rankable(panel, models).select(*KEYS, *models, *keep)
        return with_group_columns(rows, ["Date"], list(models), _ensemble_of_date, [output], "Code", REPEATED)
    ranks = model_ranks(panel, models, profile)
    squares = {f"_{model}": F.sum(F.col(model) * F.col(model)) for model in models}
    scaled = with_group_stats(ranks, ["Date"], squares, profile)
    total = F.lit(0.0)
    for model in models:
        deviation = F.sqrt(F.col(f"_{model}") / (F.col("_n") - 1))
        total = total + F.col(model) / checked(deviation, deviation > 0, CONSTANT)
    scaled = scaled.select(*KEYS, (total / len(models)).alias(output))
    return _rankable(panel, models).select(*KEYS, *models, *keep).join(scaled, list(KEYS))


def prediction_table(scored: DataFrame, model: str, fold: str, target: str | None = None, raw: str | None = None) -> DataFrame:
    """``model, fold, Date, Code, prediction[, target, raw_return]`` rows for the sink."""
    columns = [F.lit(model).alias("model"), F.lit(fold).alias("fold"), "Date", F.col("Code").cast("string").alias("Code"), "prediction"]
    if target is not None:
        columns.append(F.col(target).alias("target"))
    if raw is not None:
        columns.append(F.col(raw).alias("raw_return"))
    return scored.select(*columns)
