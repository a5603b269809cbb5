"""Batch jobs: each reads tables, runs for all dates at once, and writes a table.

Every stage boundary is a written table, so a lost executor or a failed stage
never repeats the stages before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry as R
from ..operators import calendar as C
from ..operators import learn
from ..operators.contracts import require_columns, staged
from ..operators.features import project_protocol_features, raw_feature_panel
from ..operators.labels import build_labels, label_spec
from ..operators.metrics import daily_predictive_metrics
from ..operators.normalize import mad_zscore
from ..operators.portfolio import backtest_grid, period_portfolio_summary, period_predictive_summary
from ..operators.groups import profile_groups
from ..operators.predictions import (
    align_predictions,
    average_daily_spearman,
    prediction_table,
    read_prediction,
    stack_predictions,
    with_ensemble,
)
from ..operators.universe import (
    complete_history_universe,
    entry_eligible_universe,
    entry_to_signal,
    normalized_keys,
    on_entry_dates,
    prepare_model_panel,
    split_samples,
)
from ..session import stage
from ..sources import tables as S


def build_features(
    spark: SparkSession, daily: str, minutes: str, output: str, protocol: str = "o2o",
    calendar: str | None = None, raw_output: str | None = None, dates: tuple[int, int] | None = None, tree: bool = False,
) -> str:
    """Bars to normalised, projected features of every signal date, partitioned by Date.

    *raw_output* also keeps the raw panel.  *dates* limits the signal dates after the look-back windows.
    With *tree* the minutes lie in ``<YYYYMMDD>/<HHMM>.parquet``.
    """
    daily_bars = S.read_daily_bars(spark, daily)
    minute_bars = S.read_session_tree(spark, minutes) if tree else S.read_minute_sessions(spark, minutes)
    days = S.read_frame(spark, calendar) if calendar else None
    raw = raw_feature_panel(daily_bars, minute_bars, protocol, days)
    if dates is not None:
        raw = raw.filter(F.col("Date").between(*dates))
    return write_features(raw, output, protocol, raw_output)


def write_features(raw: DataFrame, output: str, protocol: str, raw_output: str | None = None, only_own: bool = False) -> str:
    """Normalise, project and write a raw panel by Date; an empty panel, or one without a family, fails."""
    # An empty part would leave the panel empty, or without a family of features.
    parts = {"no stock-day has both daily and half-hour features": F.col("Date").isNotNull()}
    if R.protocol_key(protocol) == "de":
        opening = F.coalesce(*[F.col(name) for name in R.EARLY_OPEN_COLUMNS])
        parts["no stock-day has early-open features"] = opening.isNotNull()
    raw = staged(raw, some=parts)
    if raw_output:
        S.write_parquet(raw, raw_output, ["Date"], only_own=only_own)
    selected = project_protocol_features(mad_zscore(raw), protocol)
    return S.write_parquet(selected, output, ["Date"], only_own=only_own)


def build_label_table(
    spark: SparkSession, minutes: str, output: str, protocol: str = "o2o", calendar: str | None = None
) -> str:
    """Minute bars to labels of every signal date."""
    bars = S.read_minute_sessions(spark, minutes)
    days = S.read_frame(spark, calendar) if calendar else None
    return S.write_parquet(build_labels(bars, protocol, days), output)


def build_splits(
    spark: SparkSession, signal_dates: str, calendar: str, output: str,
    folds: Sequence[C.Fold] = C.FIXED_FOLDS, purge: int = C.PURGE_SIGNAL_DATES,
) -> str:
    """Rolling date roles, validated and written as one CSV."""
    roles = stage(C.date_roles(S.read_frame(spark, signal_dates), S.read_frame(spark, calendar), folds, purge))
    C.check_date_roles(roles, purge)
    return S.write_report(roles, output, ["fold_id", "signal_date"])


def model_panel(
    features: DataFrame, labels: DataFrame, eligibility: DataFrame, calendar: DataFrame, roles: DataFrame,
    names: Sequence[str], protocol: str, length: int = R.SEQUENCE_LENGTH,
) -> DataFrame:
    """Assemble the model panel from its five inputs."""
    spec = label_spec(protocol)
    mapping = stage(entry_to_signal(roles))
    eligible = entry_eligible_universe(on_entry_dates(eligibility, mapping), mapping)
    history = complete_history_universe(features, calendar, length)
    return prepare_model_panel(features, labels, names, spec.raw_column, spec.target_column, eligible, history)


def prepare_panel(
    spark: SparkSession, features: str, labels: str, eligibility: str, calendar: str, splits: str, output: str,
    protocol: str = "o2o", manifest: str | None = None, length: int = R.SEQUENCE_LENGTH,
) -> str:
    """Read the inputs, build the model panel, write it partitioned by Date."""
    names = S.load_feature_manifest(spark, protocol, manifest).columns
    panel = model_panel(
        normalized_keys(S.read_frame(spark, features)),
        normalized_keys(S.read_frame(spark, labels)),
        S.read_frame(spark, eligibility),
        S.read_frame(spark, calendar),
        S.read_date_roles(spark, splits),
        names,
        protocol,
        length,
    )
    return S.write_parquet(panel, output, ["Date"])


def train(
    spark: SparkSession, panel: str, splits: str, output: str, protocol: str = "o2o", fold: str = "F1",
    preset: str = "lgb", names: Sequence[str] | None = None, patience: int = learn.PATIENCE, seed: int = 42,
    **overrides: object,
) -> dict[str, str]:
    """Fit one tree model on one fold; write model, history and both prediction sets."""
    spec = label_spec(protocol)
    names = list(names or R.manifest_of(protocol).columns)
    table, roles = spark.read.parquet(panel), S.read_date_roles(spark, splits)
    require_columns(table, [*names, spec.target_column, spec.raw_column, "is_eligible", "is_scoreable"], "model panel")
    samples = {split: split_samples(table, roles, fold, split) for split in C.SPLITS}
    model, history = learn.train_on_panel(
        samples["train"], samples["validation"], names, spec.target_column, preset, patience, seed, **overrides
    )
    paths = {
        "model": f"{output}/model/{preset}/{fold}",
        "history": f"{output}/history/{preset}/{fold}",
        "predictions": f"{output}/predictions",
    }
    learn.save_model(model, paths["model"])
    S.write_report(history, paths["history"], ["round"])
    for split in ("validation", "test"):
        _write_scores(model, samples[split], names, spec, preset, fold, split, paths["predictions"])
    return paths


def _write_scores(model, rows: DataFrame, names, spec, preset: str, fold: str, split: str, root: str) -> None:
    scored = learn.predict(model, rows, names, spec.target_column, spec.raw_column)
    S.write_predictions(prediction_table(scored, preset, fold, spec.target_column, spec.raw_column), root, split)


def predict(
    spark: SparkSession, panel: str, splits: str, model_path: str, output: str, protocol: str = "o2o",
    fold: str = "F1", split: str = "test", preset: str = "lgb", names: Sequence[str] | None = None,
) -> str:
    """Score the eligible rows of one fold and split with a saved model.

    Unlike training samples, every eligible row is scored, with or without an outcome.
    """
    spec = label_spec(protocol)
    names = list(names or R.manifest_of(protocol).columns)
    table, roles = spark.read.parquet(panel), S.read_date_roles(spark, splits)
    dates = C.active_split_dates(roles, fold, split)
    rows = table.filter("is_eligible") if "is_eligible" in table.columns else table
    rows = rows.join(F.broadcast(dates), "Date", "left_semi")  # one row per trading day
    _write_scores(learn.load_model(model_path), rows, names, spec, preset, fold, split, output)
    return output


def evaluate(long: DataFrame, outcomes: DataFrame, outcome: str = "raw_return",
             models: Sequence[str] = R.EIGHT_MODELS, label: str = "2024-2025") -> dict[str, DataFrame]:
    """Score panels of all models and their ensemble to the five report tables.

    All models, the ensemble and the outcomes run as one wide panel, of one row a key; periods come from grouping sets.
    """
    aligned = stage(align_predictions(long, models, outcomes, outcome))
    profile = profile_groups(aligned, ["Date"])
    panel = stage(with_ensemble(aligned, models, "ensemble", profile, keep=[outcome]))
    scores = [*models, "ensemble"]
    some = {"there is no prediction to evaluate": F.col("Date").isNotNull()}
    grid = backtest_grid(panel, outcome=outcome, keys=("Date",), profile=profile, models=scores)
    portfolios = staged(grid, some=some)
    predictive = stage(daily_predictive_metrics(panel, outcome=outcome, keys=("Date",), profile=profile, models=scores))
    ensemble = panel.select("Date", "Code", F.col("ensemble").alias("prediction"))
    return {
        "prediction_correlation": average_daily_spearman(aligned, models, profile),
        "ensemble_predictions": ensemble,
        "daily_portfolios": portfolios,
        "daily_predictive_metrics": predictive,
        "portfolio_summary": period_portfolio_summary(portfolios, label),
        "predictive_summary": period_predictive_summary(predictive, label),
    }


def backtest(
    spark: SparkSession, predictions: str, output: str, outcomes: str | None = None, outcome: str = "raw_return",
    models: Sequence[str] = R.EIGHT_MODELS, label: str = "2024-2025", files: bool = False,
) -> str:
    """Evaluate prediction tables (partitioned, or one file per model) and write the reports."""
    if files:
        sources = S.read_prediction_files(spark, predictions, models)
        first, long = sources[models[0]], stack_predictions(sources, models=models)
    else:
        table = S.read_model_predictions(spark, predictions).filter(F.col("model").isin(*models))
        first = table.filter(F.col("model") == models[0])
        long = read_prediction(table, keep=["model"])
    if outcomes:
        realised = S.read_frame(spark, outcomes)
    else:
        require_columns(first, [outcome], "first model predictions")
        realised = first.select("Date", "Code", outcome)
    reports = evaluate(long, realised, outcome, models, label)
    for name in ("ensemble_predictions", "daily_portfolios"):
        S.write_parquet(reports[name], f"{output}/{name}")
    orders = {
        "prediction_correlation": ["model_a", "model_b"],
        "daily_predictive_metrics": ["model", "Date"],
        "portfolio_summary": ["period", "model", "mode", "quantile"],
        "predictive_summary": ["period", "model"],
    }
    for name, order in orders.items():
        S.write_report(reports[name], f"{output}/{name}", order)
    return output
