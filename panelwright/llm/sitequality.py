"""Quality classifier: document evidence shrunk through site and path posteriors.

Three levels share evidence.  A ridge logistic model on cheap text features gives each document
its own probability p.  A site's posterior is the mean of its documents' p, shrunk to the global
mean; a path's posterior is the mean of its other documents' p (leave one out), shrunk to its
site.  The strength of each shrinkage (in documents) is estimated from the spread between groups
by the method of moments: sparse groups follow their prior, large ones their own evidence.  The
final log-odds are the document's own plus what its path adds over the global rate.

Group posteriors are sums and counts, combined before the shuffle, so a hot site costs one row
per task.  The model is fitted on at most ``max_fit`` labelled rows, those with the smallest hash
of their id; every document is scored.

Defined cases: NULL text counts as empty; NULL site or path is a group of its own; a NULL label
is no label; without labels every p is one half; several labels of one document all count;
repeated rows are scored alike, each on its own and each counted in its groups; an empty table
gives an empty table.  Other columns are ignored (``score_quality``) or kept (``keep_good``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import byte_counts, fit_logistic, fixed_lists, row_of, ship, unpacked, with_columns
from panelwright.session import stage

ship(__name__)

FEATURES = (
    "upper", "digit", "stop", "exclaim", "pipe", "symbol", "wide", "word_length", "log_words", "short", "distinct",
    "repeated_next", "line_words", "distinct_lines", "upper_words", "symbol_words",
)
MAX_FIT = 20_000
RIDGE = 1.0
KEEP_AT = 0.5


def _features():
    def pick(chars: bytes):
        return np.frombuffer(chars, np.uint8)

    stop, symbol = pick(b".,;:?'\"()-"), pick(b"#*$%&<>@^~_=+\\/{}[]")

    def kernel(texts):
        rows = []
        for text in texts:
            counts, words = byte_counts(text), text.split()
            n, size = len(words), max(1, len(text))
            lines = [x for x in text.split(b"\n") if x.strip()]
            rows.append(np.array([
                counts[65:91].sum() / size, counts[48:58].sum() / size, counts[stop].sum() / size, counts[33] / size,
                counts[124] / size, counts[symbol].sum() / size, counts[0xC0:].sum() / size, len(text) / max(1, n) / 10,
                np.log1p(n) / 10, float(n < 20), len(set(words)) / max(1.0, n) * min(1.0, np.log1p(n) / 7),
                sum(map(bytes.__eq__, words, words[1:])) / max(1, n), np.log1p(n / max(1, len(lines))) / 5,
                len(set(lines)) / max(1, len(lines)), sum(map(bytes.isupper, words)) / max(1, n),
                sum(not w[-1:].isalnum() and w[-1] in b"#*$%&!|" for w in words) / max(1, n),
            ]))
        return [fixed_lists(rows, pa.float64())]

    return kernel


def with_features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, inside: str | None = None) -> DataFrame:
    """``docs`` with ``__features``, an array of doubles in the order of FEATURES."""
    return with_columns(docs, text_col, _features(), [("__features", T.ArrayType(T.DoubleType()))], keep, inside)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_fit: int = MAX_FIT, ridge: float = RIDGE) -> list[float]:
    """Weights on the raw features and the intercept, from a bounded sample of labelled rows."""
    picked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).filter("__y IN (0, 1) AND __id IS NOT NULL")
    picked = picked.orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_fit)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__body")).join(F.broadcast(picked), "__id")  # bounded by max_fit
    sample = with_features(rows, "__body", ["__id", "__y"]).orderBy(F.xxhash64("__id"), "__id").limit(max_fit).toPandas()
    x = np.array(sample["__features"].tolist(), float).reshape(-1, len(FEATURES))
    y = sample["__y"].to_numpy(float)
    if len(y) == 0:
        return [0.0] * (len(FEATURES) + 1)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    w = fit_logistic((x - centre) / scale, y, ridge)
    raw = w[:-1] / scale
    return [*map(float, raw), float(w[-1] - raw @ centre)]


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _evidence(weights: list[float]) -> Column:
    value = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        value = value + F.col("__features")[i] * F.lit(w)
    return F.greatest(F.lit(-8.0), F.least(F.lit(8.0), value))


def _strength(groups: DataFrame, mean: str) -> Column:
    """Prior size in documents: within-group spread over between-group spread, at least 1."""
    inner = F.sum(F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n"))) / F.greatest(F.lit(1.0), F.sum(F.col("n") - 1))
    centre = F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")
    outer = (F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(mean), 2)) - inner * (F.count(F.lit(1)) - 1)) / F.greatest(F.lit(1.0), centre)
    return F.least(F.lit(1e6), F.greatest(F.lit(1.0), inner / F.greatest(F.lit(1e-9), outer)))


def group_posteriors(scored: DataFrame) -> DataFrame:
    """Per (site, path): document sums and the posteriors of the path's site and of all documents.

    ``scored`` has ``site``, ``path`` and ``p``.
    """
    paths = stage(scored.groupBy("site", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    world = paths.agg((F.sum("s") / F.sum("n")).alias("world"))
    sites = sites.join(F.broadcast(world), F.lit(True), "left")  # one row
    site_size = sites.agg(_strength(sites, "world").alias("site_strength"))
    sites = sites.join(F.broadcast(site_size), F.lit(True), "left").select(
        F.col("site").alias("__site"), "world", "site_strength",
        ((F.col("s") + F.col("site_strength") * F.col("world")) / (F.col("n") + F.col("site_strength"))).alias("site_post"),
    )
    paths = stage(paths.join(sites, F.col("site").eqNullSafe(F.col("__site"))).drop("__site"))
    size = paths.agg(_strength(paths, "site_post").alias("path_strength"))
    return stage(paths.join(F.broadcast(size), F.lit(True), "left").select(
        F.col("site").alias("__site"), F.col("path").alias("__path"), "n", "s", "world", "site_post", "path_strength",
    ))


def _combined(scored: DataFrame) -> DataFrame:
    """Rows with site, path, evidence and p get the posteriors and the final score."""
    groups = group_posteriors(scored)
    rows = scored.join(groups, F.col("site").eqNullSafe(F.col("__site")) & F.col("path").eqNullSafe(F.col("__path")))
    others = (F.col("s") - F.col("p") + F.col("path_strength") * F.col("site_post")) / (F.col("n") - 1 + F.col("path_strength"))
    rows = rows.withColumn("path_post", others)
    total = F.col("evidence") + _logit(F.col("path_post")) - _logit(F.col("world"))
    return rows.withColumn("score", 1 / (1 + F.exp(-total)))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site: str | Column = "source",
    path: str | Column = "lang", keep_at: float = KEEP_AT, max_fit: int = MAX_FIT,
) -> DataFrame:
    """Per document: doc_id, evidence (log-odds), site_post, path_post, score (0 to 1), kept."""
    weights = fit(docs, labels, id_col, text_col, max_fit=max_fit)
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(F.col(id_col).alias("doc_id"), column(site).cast("string").alias("site"), column(path).cast("string").alias("path"), F.col(text_col).alias("__body"))
    rows = with_features(rows, "__body", ["doc_id", "site", "path"]).withColumn("evidence", _evidence(weights))
    rows = stage(rows.withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))).drop("__features"))
    return _combined(rows).select("doc_id", "evidence", "site_post", "path_post", "score", (F.col("score") >= keep_at).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site: str = "source", path: str = "lang",
              keep_at: float = KEEP_AT, max_fit: int = MAX_FIT) -> DataFrame:
    """The rows of ``docs`` that score at least ``keep_at``, with all their columns."""
    weights = fit(docs, labels, id_col, text_col, max_fit=max_fit)
    names = list(docs.columns)
    rows = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    rows = rows.select(row_of(rows), F.col(site).cast("string").alias("site"), F.col(path).cast("string").alias("path"))
    rows = with_features(rows, "row", ["row", "site", "path"], text_col).withColumn("evidence", _evidence(weights)).drop("__features")
    # staged, so that texts are measured once for the posteriors and the rows
    rows = stage(rows.withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))))
    return _combined(rows).filter(F.col("score") >= keep_at).select(*unpacked(names))
