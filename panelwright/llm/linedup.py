"""Line dedup: repeated line runs from a suffix order built by distributed prefix doubling.

The corpus is one sequence of line ids, document after document by id.  Round by round, suffixes
are put into classes by their first 1, 2, 4, ... lines: the class of 2k lines is the pair of the
classes of k lines at a line and k lines on, named by its earliest member.  A suffix that is alone
in its class, or reaches the end of its document, leaves the table (it has no longer repeat), so
tables shrink to the repeated text.  These nested classes are the levels of the suffix array: a
class is an interval of suffixes with a common prefix of that length.

A run counts when it has at least ``min_words`` words.  For each line, the shortest run of that
size that starts there, and the shortest that ends there, are looked up: a run of L lines has the
classes of k lines at both its ends (k the largest power of two up to L), which is the interval of
the suffixes that share those L lines.  Members after the earliest are later copies.  Together the
copies' runs cover exactly the maximal repeated runs of enough words; their lines are deleted.

Only DataFrame functions are used.  No task holds a class or a document group: classes are counts
and minima, combined before the shuffle, then joined back.

Defined cases: lines are split at \\n and compared as they are; NULL text has no lines and stays
NULL; an empty text has one empty line; repeated rows (same id and text) count as one document
and get the same result each; rows with the same id and different texts are different documents,
in order of a hash of the text; an empty table gives an empty table; other columns are ignored
(``repeated_runs``) or kept (``dedup``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import WORD, row_of, unpacked
from panelwright.session import stage

MIN_WORDS = 50


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line: document (d, t), pos, 128-bit line id (h, g), words, and its global place p."""
    text = F.col(text_col).cast("string")
    lines = docs.select(F.col(id_col).alias("d"), _key(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select(
        "d", "t", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), F.col("line")).alias("g"),
        F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"),
    )
    # equal (d, t, pos) come together, so dropping repeated rows needs no further exchange
    lines = lines.repartitionByRange("d", "t", "pos").dropDuplicates(["d", "t", "pos"]).sortWithinPartitions("d", "t", "pos")
    return stage(lines.withColumn("p", F.monotonically_increasing_id()))


def candidate_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of enough words from each line on and up to each line: d, t, pos, size."""
    doc = Window.partitionBy("d", "t")
    rows = lines.withColumn("upto", F.sum("words").over(doc.orderBy("pos"))).withColumn("before", F.col("upto") - F.col("words"))
    rows = rows.withColumn("total", F.sum("words").over(doc))
    rows = rows.withColumn("last", F.max("pos").over(doc.orderBy("before").rangeBetween(0, min_words - 1)))
    rows = rows.withColumn("first", F.min("pos").over(doc.orderBy("upto").rangeBetween(1 - min_words, 0)))
    on = F.when(F.col("total") - F.col("before") >= min_words, F.struct(F.col("pos"), (F.col("last") - F.col("pos") + 1).alias("size")))
    up = F.when(F.col("upto") >= min_words, F.struct(F.col("first").alias("pos"), (F.col("pos") - F.col("first") + 1).alias("size")))
    runs = rows.select("d", "t", F.explode(F.array_compact(F.array_distinct(F.array(on, up)))).alias("run")).select("d", "t", "run.pos", "run.size")
    return runs.distinct()


def prefix_classes(lines: DataFrame, longest: int) -> DataFrame:
    """Classes of more than one suffix: k, d, t, pos, p, name (the place of the earliest member)."""
    groups = lines.groupBy("h", "g").agg(F.min("p").alias("name"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "g", "name")
    level = stage(lines.join(groups, ["h", "g"]).select("d", "t", "pos", "p", "name"))
    k, levels = 1, [level.withColumn("k", F.lit(1))]
    while 2 * k <= longest:
        on = level.select("d", "t", (F.col("pos") - k).alias("pos"), F.col("name").alias("next"))
        pairs = stage(level.join(on, ["d", "t", "pos"]))
        groups = pairs.groupBy("name", "next").agg(F.min("p").alias("made"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        level = stage(pairs.join(groups, ["name", "next"]).select("d", "t", "pos", "p", F.col("made").alias("name")))
        k *= 2
        if level.isEmpty():
            break
        levels.append(level.withColumn("k", F.lit(k)))
    classes = levels[0]
    for level in levels[1:]:
        classes = classes.unionByName(level)
    return classes


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies as maximal spans of lines: d, t, first, last (places in the document)."""
    lines = line_table(docs, id_col, text_col)
    runs = stage(candidate_runs(lines, min_words))
    longest = runs.agg(F.max("size").alias("n")).first().n or 1
    classes = prefix_classes(lines, longest)
    # log2 of a whole number up to 2^53 is exact at powers of two
    runs = runs.withColumn("k", F.expr("cast(shiftleft(1L, cast(floor(log2(size)) AS INT)) AS INT)"))
    head = classes.select("d", "t", "k", "pos", "p", F.col("name").alias("head"))
    tail = classes.select("d", "t", "k", F.col("pos").alias("at"), F.col("name").alias("tail"))
    found = runs.join(head, ["d", "t", "k", "pos"]).withColumn("at", (F.col("pos") + F.col("size") - F.col("k")).cast("int"))
    found = stage(found.join(tail, ["d", "t", "k", "at"]).select("d", "t", "pos", "size", "p", "head", "tail"))
    first = found.groupBy("size", "head", "tail").agg(F.min("p").alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = found.join(first, ["size", "head", "tail"]).filter("p > earliest").select("d", "t", F.col("pos").alias("first"), (F.col("pos") + F.col("size") - 1).alias("last"))
    doc = Window.partitionBy("d", "t").orderBy("first", "last")
    reach = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    copies = copies.withColumn("new", (F.coalesce(reach, F.lit(-2)) < F.col("first") - 1).cast("int")).withColumn("span", F.sum("new").over(doc))
    return copies.groupBy("d", "t", "span").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("span")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``__lines`` (how many), ``__deleted`` (how many) and ``__left`` (the text that stays)."""
    if not {"__lines", "__deleted", "__left"}.isdisjoint(docs.columns):
        raise ValueError("a derived column would repeat a name of the frame")
    return _deduped(docs, id_col, text_col, min_words).select(*unpacked(docs.columns), "__lines", "__deleted", "__left")


def _deduped(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """row (all columns of ``docs``), __lines, __deleted, __left."""
    spans = repeated_runs(docs, id_col, text_col, min_words).groupBy("d", "t").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    rows = docs.select(row_of(docs), F.col(id_col).alias("own"), _key(F.col(text_col).cast("string")).alias("key"))
    rows = rows.join(spans, F.col("own").eqNullSafe(F.col("d")) & (F.col("key") == F.col("t")), "left")
    text = F.col("row").getField(text_col).cast("string")
    lines = F.split(text, "\n")
    left = F.filter(lines, lambda line, i: ~F.exists(F.col("spans"), lambda s: (s["first"] <= i) & (s["last"] >= i)))
    kept = F.when(F.col("spans").isNull(), text).otherwise(F.array_join(left, "\n"))
    deleted = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1), F.lit(0).cast("long"))
    size = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return rows.select("row", size.alias("__lines"), deleted.alias("__deleted"), kept.alias("__left"))


SQL = f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    w AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS words FROM l),
    u AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, sum(words) OVER (PARTITION BY doc_id) AS total FROM w),
    b AS (SELECT *, upto - words AS before FROM u),
    r AS (SELECT *, max(pos) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING) AS last,
          min(pos) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW) AS first FROM b),
    runs AS (SELECT doc_id, pos AS first, last FROM r WHERE total - before >= {MIN_WORDS}
             UNION SELECT doc_id, first, pos AS last FROM r WHERE upto >= {MIN_WORDS}),
    keyed AS (SELECT r.doc_id, r.first, r.last, array_to_string(string_split(d.text, chr(10))[r.first + 1 : r.last + 1], chr(10)) AS body
              FROM runs r JOIN documents d USING (doc_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY body, last - first ORDER BY doc_id, first) AS n FROM keyed),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS pos FROM ranked WHERE n > 1),
    kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY 1),
    gone_n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
    SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(g.n, 0) AS n_deleted,
           CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.body, '')) END AS left_md5
    FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN gone_n g USING (doc_id)"""


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, n_lines, n_deleted, left_md5 (of the text that stays)."""
    rows = dedup(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", min_words)
    return rows.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__deleted").alias("n_deleted"), F.md5("__left").alias("left_md5"))


def keep_first_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of runs; rows of which no word stays, though lines were deleted, go."""
    rows = _deduped(docs, id_col, text_col, min_words).filter(~((F.col("__deleted") > 0) & ~F.col("__left").rlike(WORD)))
    return rows.select(*unpacked(docs.columns, **{text_col: F.col("__left")}))
