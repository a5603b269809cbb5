"""Quality rules: base counts, and how far a document's histograms diverge from its language.

A document gets two histograms: character classes, and the common function words (all other
words share one last cell).  The reference of a language is the mean of the histograms of its
long enough documents, over the whole corpus (of character classes the median of each class,
scaled to one, so that odd documents do not shift it).  The Jensen-Shannon distance (base 2, 0 to 1)
between the two decides, under minimum-length guards.  How far common words may lie is taken
from the corpus: in each language and length band (powers of two, since short texts scatter more)
the limit is the median distance and SPREADS times the spread of the half below it, which texts
without common words or in another language do not widen.

Defined cases: NULL text counts as empty; an empty or short text has no divergence (the guards
leave it NULL) and fails the base rule; a NULL language, or one without a reference, is held
against the reference of all documents; repeated rows are judged alike, each on its own; an
empty table gives an empty table.  Other columns are ignored (``quality_rules``) or kept as they
are (``keep_passing``).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import byte_counts, fixed_lists, row_of, ship, unpacked, with_columns
from panelwright.session import stage

ship(__name__)

#: Frequent function words of some languages; one shared list of cells.
COMMON_WORDS = {
    "en": "the of and to in a is that for was on with by this at are as it from be or an",
    "fr": "le la les de des du et un une en que qui est dans pour par au aux avec sur pas ne",
    "de": "der die das und in den von zu mit ist des auf für dem nicht ein eine als auch sich im",
    "es": "el la los las de del y que en un una es por con para se no al lo su como más",
}
VOCABULARY = tuple(dict.fromkeys(w.encode() for words in COMMON_WORDS.values() for w in words.split()))

#: The symbols that are counted, and sentence punctuation.
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:!?'\"()-"

#: Character classes, in the order of the histogram.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "wide", "other")

MIN_CHAR_WORDS = 20
MIN_COMMON_WORDS = 100
MAX_CHAR_DISTANCE = 0.26
MAX_WORD_DISTANCE = 0.75  # only where no band has LEAST_DOCS documents

SPREADS = 5
LEAST_SPREAD = 0.02
LEAST_DOCS = 20
LAST_BAND = 12

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in a window of five that occurs at least twice."""
    n = len(words)
    if n < 6:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    key = codes[: n - 4].copy()
    for k in range(1, 5):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key += codes[k : n - 4 + k]
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0  # equal windows have equal keys
    starts = np.flatnonzero(np.isin(key, again))
    texts = [b" ".join(words[i : i + 5]) for i in starts]
    times = Counter(texts)
    hit = np.zeros(n, bool)
    for i, text in zip(starts, texts):
        if times[text] > 1:
            hit[i : i + 5] = True
    return int(hit.sum())


def _kernel():
    lower = np.zeros((256, len(CLASSES)), np.int64)
    for code in range(256):
        c = bytes([code])
        lower[code, 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in STOPS else 5 if c in SYMBOLS else 6 if code >= 0xC0 else 7] = 1
    lower[0x80:0xC0] = 0  # continuation bytes belong to the character before
    clean = bytes(32 if bytes([c]) in STOPS else c for c in range(256))
    symbols = np.frombuffer(SYMBOLS, np.uint8)
    cell = {w: i for i, w in enumerate(VOCABULARY)}

    def kernel(texts):
        base, chars, commons = [], [], []
        for text in texts:
            words = text.split()
            counts = byte_counts(text)
            classes = counts @ lower
            lines = [x for x in text.split(b"\n") if x.strip()] if words else []
            base.append((
                len(words), int(classes.sum() - classes[3]), int(counts[symbols].sum()), len(lines) - len(set(lines)),
                repeat_words(words),
            ))
            plain = text.lower().translate(clean).split()
            histogram = np.zeros(len(VOCABULARY) + 1, np.int64)
            times = Counter(plain)
            for word in cell.keys() & times.keys():
                histogram[cell[word]] = times[word]
            histogram[-1] = len(plain) - histogram.sum()
            chars.append(classes)
            commons.append(histogram)
        columns = np.array(base, np.int64).reshape(-1, len(BASE))
        return [*columns.T, fixed_lists(chars, pa.int64()), fixed_lists(commons, pa.int64())]

    return kernel


def _measured(docs: DataFrame, text_col: str, keep: list[str], inside: str | None = None) -> DataFrame:
    """The kept columns and the counts of each text; staged, so that every text is measured once."""
    fields = [(f"__{n}", T.LongType()) for n in BASE] + [("__chars", T.ArrayType(T.LongType())), ("__common", T.ArrayType(T.LongType()))]
    return stage(with_columns(docs, text_col, _kernel(), fields, keep, inside))


def _base_failed() -> Column:
    return (F.col("__n_words") < 10) | (F.lit(100) * F.col("__n_repeat_words") > F.lit(20) * F.col("__n_words"))


def _shares(counts: str) -> Column:
    return F.expr(f"transform({counts}, x -> x / aggregate({counts}, 0L, (a, b) -> a + b))")


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance: the root of the divergence in bits."""
    def part(a: Column, b: Column) -> Column:
        half = F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
        return half + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def _band() -> Column:
    return F.least(F.floor(F.log2(F.col("__n_words"))), F.lit(LAST_BAND)).cast("int")


def _limits(rows: DataFrame, references: DataFrame) -> DataFrame:
    """ref_lang, ref_limits: the largest common-word distance of each length band with enough documents."""
    rows = rows.select("__lang", _band().alias("band"), "w")
    bare = F.array(*[F.lit(0.0)] * len(VOCABULARY), F.lit(1.0))  # a text without common words
    references = references.withColumn("bare", _distance(bare, F.col("ref_common")))
    own = rows.join(references.filter("ref_lang IS NOT NULL"), F.col("__lang") == F.col("ref_lang"))
    every = rows.crossJoin(F.broadcast(references.filter("ref_lang IS NULL")))  # one row
    far = [x.select("ref_lang", "band", "bare", _distance(F.col("w"), F.col("ref_common")).alias("d")) for x in (own, every)]
    bands = far[0].unionAll(far[1]).groupBy("ref_lang", "band").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("d", [0.25, 0.5], 1000).alias("q"), F.first("bare").alias("bare"))
    spread = F.greatest((F.col("q")[1] - F.col("q")[0]) / 0.6745, F.lit(LEAST_SPREAD))
    bands = bands.filter(F.col("n") >= LEAST_DOCS).select("ref_lang", "band", F.col("q")[1].alias("middle"), spread.alias("spread"), (F.col("bare") * 0.99).alias("bare"))
    # no wider than texts without common words lie, if the language's texts are well below that
    limit = F.col("middle") + SPREADS * F.col("spread")
    limit = F.when(F.col("bare") > F.col("middle") + 3 * F.col("spread"), F.least(limit, "bare")).otherwise(limit)
    bands = bands.select("ref_lang", F.struct("band", limit.alias("limit")).alias("x"))
    return bands.groupBy("ref_lang").agg(F.map_from_entries(F.collect_list("x")).alias("ref_limits"))


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per language (and one with NULL for all documents): middle histograms as arrays, and word limits by band.

    Only documents that pass the base rule and the longer guard count, each with weight one.
    Means and medians are combined before the shuffle: a language with most rows needs no task of its own.
    """
    return _references(_measured(docs.select(F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__body")), "__body", ["__lang"]))


def _references(measured: DataFrame) -> DataFrame:
    rows = measured.filter(~_base_failed() & (F.col("__n_words") >= MIN_COMMON_WORDS))
    rows = rows.select("__lang", "__n_words", _shares("__chars").alias("c"), _shares("__common").alias("w"))
    k, m = len(CLASSES), len(VOCABULARY) + 1
    middle = [F.percentile_approx(F.col("c")[i], 0.5, 1000).alias(f"c{i}") for i in range(k)] + [F.avg(F.col("w")[i]).alias(f"w{i}") for i in range(m)]
    both = rows.groupBy("__lang").agg(F.count(F.lit(1)).alias("n"), *middle)
    scale = sum((F.col(f"c{i}") for i in range(k)), F.lit(0.0))
    both = both.withColumns({f"c{i}": F.col(f"c{i}") / scale for i in range(k)})
    whole = [(F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias(x) for x in [f"c{i}" for i in range(k)] + [f"w{i}" for i in range(m)]]
    both = stage(both)
    packed = [
        F.array(*[F.col(f"c{i}") for i in range(k)]).alias("ref_chars"), F.array(*[F.col(f"w{i}") for i in range(m)]).alias("ref_common"),
    ]
    every = both.agg(*whole).filter("c0 IS NOT NULL").select(F.lit(None).cast("string").alias("ref_lang"), *packed)
    references = stage(both.filter("__lang IS NOT NULL").select(F.col("__lang").alias("ref_lang"), *packed).unionByName(every))
    limits = _limits(rows, references).withColumnRenamed("ref_lang", "of")
    return stage(references.join(limits, F.col("ref_lang").eqNullSafe(F.col("of")), "left").drop("of"))


def _judged(measured: DataFrame, references: DataFrame, lang: Column, max_char: float, max_word: float | None) -> DataFrame:
    """Measured rows with ``__char_distance``, ``__word_distance`` and ``__kept``."""
    own = references.filter("ref_lang IS NOT NULL")
    every = references.filter("ref_lang IS NULL").agg(F.first("ref_chars").alias("all_chars"), F.first("ref_common").alias("all_common"), F.first("ref_limits").alias("all_limits"))
    rows = measured.join(own, lang == F.col("ref_lang"), "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    char = _distance(_shares("__chars"), F.coalesce("ref_chars", "all_chars"))
    word = _distance(_shares("__common"), F.coalesce("ref_common", "all_common"))
    rows = rows.withColumns({
        "__char_distance": F.when(F.col("__n_words") >= MIN_CHAR_WORDS, char),
        "__word_distance": F.when(F.col("__n_words") >= MIN_COMMON_WORDS, word),
    })
    limit = F.lit(max_word)
    if max_word is None:
        # a band without a limit takes the widest of its language
        found = [f(c) for c in ("ref_limits", "all_limits") for f in (lambda c: F.try_element_at(c, _band()), lambda c: F.array_max(F.map_values(c)))]
        limit = F.coalesce(*found, F.lit(MAX_WORD_DISTANCE))
    far = (F.coalesce("__char_distance", F.lit(0.0)) > max_char) | (F.coalesce("__word_distance", F.lit(0.0)) > limit)
    return rows.withColumn("__kept", ~_base_failed() & ~far)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", references: DataFrame | None = None,
    max_char: float = MAX_CHAR_DISTANCE, max_word: float | None = None,
) -> DataFrame:
    """Per document: id, base counts, base_failed, both distances (NULL below the guards), kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__body"))
    measured = _measured(rows, "__body", ["doc_id", "__lang"])
    references = _references(measured) if references is None else references
    rows = _judged(measured, references, F.col("__lang"), max_char, max_word)
    return rows.select(
        "doc_id", *[F.col(f"__{n}").alias(n) for n in BASE], _base_failed().alias("base_failed"), F.col("__kept").alias("kept"),
        F.col("__char_distance").alias("char_distance"), F.col("__word_distance").alias("word_distance"),
    )


def keep_passing(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_char: float = MAX_CHAR_DISTANCE, max_word: float | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    rows = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    rows = rows.select(row_of(rows), F.col(lang_col).cast("string").alias("__lang"))
    measured = _measured(rows, "row", ["row", "__lang"], text_col)
    rows = _judged(measured, _references(measured), F.col("__lang"), max_char, max_word)
    return rows.filter("__kept").select(*unpacked(docs.columns))
