"""Benchmark passages in training texts, from a distributed positional inverted index.

Index: tasks gather the documents they read into shards of about ``shard_words`` words.  A shard is one
row of a table: its documents with their lengths, its terms, and for every term the ascending list of the
places where it stands.  Places count on through the shard; a place without a word lies between two
documents, so no phrase reaches across.  All tokens of all documents are indexed, whatever is searched
later.

Search: the test texts are cut into windows of ``window`` consecutive words (a shorter text is one window).
Distinct windows meet the shards in blocks of at most ``block`` windows; a shard never moves.  In a
shard a window starts from the list of its rarest term there and drops the places around which the
next rarer terms do not stand; a term without a list ends it at once.  Phrases: the lists, each less the offset
of its term, are intersected from the rarest on.  Proximity: all different words of the window lie within
``near`` consecutive words of one document, in any order.

Words are maximal runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII.

Defined cases: a NULL or empty text has no words and no windows; repeated and NULL document ids are documents of
their own; a NULL item id takes part in hits but is no item; rows that share an item id are one
item; a window that several items share counts for each; an empty test table hits nothing, an empty table of
documents gives an empty table; other columns are ignored.  A document, however long, lies in one shard.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelwright.llm.common import ship, text_bytes
from panelwright.session import stage

ship(__name__)

WINDOW, NEAR = 10, 20
SHARD_WORDS, BLOCK, ROWS = 1_000_000, 50_000, 256
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_plain()).split()


def _plain(table=[]) -> bytes:  # noqa: B006 - made once a process
    if not table:
        table.append(bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower()))
    return table[0]


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """shard, doc_ids, sizes (words of each document), terms, ends (of each term's list), places; a written table."""

    def shard(ids, sizes, codes, terms):
        sizes = np.array(sizes, np.int32)
        codes = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        gaps = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(codes.astype(np.uint16) if len(terms) < 1 << 16 else codes, kind="stable")
        places = (np.arange(len(codes), dtype=np.int32) + gaps)[order]
        ends = np.cumsum(np.bincount(codes, minlength=len(terms))).astype(np.int32)
        lists = [pa.array([x], pa.list_(t)) for x, t in ((sizes, pa.int32()), (list(terms), pa.binary()), (ends, pa.int32()))]
        held = pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(ids))
        return pa.RecordBatch.from_arrays([held, *lists, pa.array([places.tobytes()], pa.binary())], names=["doc_ids", "sizes", "terms", "ends", "places"])

    def run(batches):
        terms: dict = defaultdict()
        terms.default_factory = terms.__len__
        ids, sizes, codes, n = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                taken = 0
                for i, text in enumerate(text_bytes(part.column(1))):
                    words = words_of(text)
                    codes.append(np.array(list(map(terms.__getitem__, words)), np.int32))
                    sizes.append(len(words))
                    n += len(words)
                    if n >= shard_words:
                        yield shard([*ids, part.column(0).slice(taken, i + 1 - taken)], sizes, codes, terms)
                        terms.clear()
                        ids, sizes, codes, n, taken = [], [], [], 0, i + 1
                ids.append(part.column(0).slice(taken))
        if sizes:
            yield shard(ids, sizes, codes, terms)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(run, f"doc_ids array<{kind}>, sizes array<int>, terms array<binary>, ends array<int>, places binary")
    return stage(rows.withColumn("shard", F.monotonically_increasing_id()), group_rows=1)  # a shard is megabytes


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """terms, items: the distinct windows and the ids of the items that hold them; a written table."""
    words = F.expr(f"regexp_extract_all(translate(CAST(`{text_col}` AS STRING), '{UPPER}', '{LOWER}'), '{PATTERN}', 0)".replace("\\", "\\\\"))
    rows = items.select(F.col(id_col).alias("item_id"), words.alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    rows = rows.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(window)).alias("terms"))
    return stage(rows.groupBy("terms").agg(F.array_sort(F.collect_set("item_id")).alias("items")))


def _covered(lists: list[np.ndarray], first: int, last: int, near: int) -> bool:
    """Does a stretch of ``near`` places in [first, last) hold a place of every list?"""
    found = sorted((int(x), i) for i, p in enumerate(lists) for x in p[np.searchsorted(p, first) : np.searchsorted(p, last)])
    latest: dict[int, int] = {}
    for x, i in found:
        latest[i] = x
        if len(latest) == len(lists) and x - min(latest.values()) < near:
            return True
    return False


def search_shard(sizes: np.ndarray, terms: list[bytes], ends: np.ndarray, places: np.ndarray, vocabulary: dict[bytes, int], windows: list[list[int]], near: int):
    """(phrases, neighbours): (window, places where it begins) and (window, documents)."""
    begin, count = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    for i, term in enumerate(terms):
        v = vocabulary.get(term)
        if v is not None:
            begin[v] = ends[i - 1] if i else 0
            count[v] = ends[i] - begin[v]
    first = np.cumsum(np.r_[0, sizes[:-1].astype(np.int64) + 1]) if len(sizes) else np.zeros(0, np.int64)
    phrases, neighbours = [], []
    for w, window in enumerate(windows):
        n = count[window]
        if not n.all():
            continue
        order = np.argsort(n, kind="stable").tolist()
        lists = {v: places[begin[v] : begin[v] + count[v]] for v in window}
        rare = list(dict.fromkeys(window[o] for o in order))  # different terms, rarest first
        x = lists[rare[0]]
        reach = max(near, len(window)) - 1
        for v in rare[1:]:
            p = lists[v]
            at = np.searchsorted(p, x - reach)
            x = x[(at < len(p)) & (p[np.minimum(at, len(p) - 1)] <= x + reach)]
            if not len(x):
                break
        if not len(x):
            continue
        starts = x - order[0]
        for o in order[1:]:
            p = lists[window[o]]
            at = np.minimum(np.searchsorted(p, starts + o), len(p) - 1)
            starts = starts[p[at] == starts + o]
        if len(starts):
            phrases.append((w, starts))
        if not near:
            continue
        inside = np.searchsorted(first, x, "right") - 1
        sure = set((np.searchsorted(first, starts, "right") - 1).tolist()) if len(window) <= near else set()
        for place, doc in zip(x.tolist(), inside.tolist()):
            if doc not in sure and _covered([lists[v] for v in rare], max(int(first[doc]), place - near + 1), min(int(first[doc] + sizes[doc]), place + near), near):
                sure.add(doc)
        if sure:
            neighbours.append((w, sorted(sure)))
    return phrases, neighbours


def _hits(shards: DataFrame, rows: list, kind: str, item: pa.DataType, near: int) -> DataFrame:
    """shard, doc, spans (low, high of hit words), items, near_items of the documents that a block of windows meets."""
    vocabulary: dict[bytes, int] = {}
    windows = [[vocabulary.setdefault(t.encode(), len(vocabulary)) for t in r.terms] for r in rows]
    owners = [r["items"] for r in rows]

    def run(batches):
        names = ["shard", "doc", "spans", "items", "near_items"]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.list_(item), pa.list_(item)]
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, ends = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 3))
                places = np.frombuffer(batch.column(4)[i].as_py(), np.int32)
                phrases, neighbours = search_shard(sizes, batch.column(2)[i].as_py(), ends, places, vocabulary, windows, near)
                first = np.cumsum(np.r_[0, sizes[:-1].astype(np.int64) + 1]) if len(sizes) else np.zeros(0, np.int64)
                change = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int64)
                spans, items, others = defaultdict(list), defaultdict(set), defaultdict(set)
                for w, starts in phrases:
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + len(windows[w]), -1)
                    for doc in np.unique(np.searchsorted(first, starts, "right") - 1).tolist():
                        items[doc].update(owners[w])
                for w, docs in neighbours:
                    for doc in docs:
                        others[doc].update(owners[w])
                edge = np.flatnonzero(np.diff(np.r_[0, (np.cumsum(change) > 0).astype(np.int8), 0]))
                for low, high in edge.reshape(-1, 2).tolist():
                    doc = int(np.searchsorted(first, low, "right")) - 1
                    spans[doc].append({"low": low - int(first[doc]), "high": high - int(first[doc])})
                docs = sorted({*spans, *others})
                columns = [[batch.column(0)[i].as_py()] * len(docs), docs, [spans[d] for d in docs], [list(items[d]) for d in docs], [list(others[d]) for d in docs]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    schema = f"shard long, doc int, spans array<struct<low: long, high: long>>, items array<{kind}>, near_items array<{kind}>"
    return shards.select("shard", "sizes", "terms", "ends", "places").mapInArrow(run, schema)


def search(shards: DataFrame, windows: DataFrame, near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """Per indexed document: doc_id, n_words, spans (hit words, each stretch once), items and near_items (ids, ascending).

    The driver holds one block of windows at a time.
    """
    kind = windows.schema["items"].dataType.elementType
    blocks = -(-windows.count() // block)
    hits = None
    for b in range(blocks):
        rows = windows.filter(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == b).collect()
        if rows:
            found = _hits(shards, rows, kind.simpleString(), to_arrow_type(kind), near)
            hits = found if hits is None else hits.unionAll(found)
    docs = shards.select("shard", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("doc", "x"))
    docs = docs.select("shard", "doc", F.col("x.doc_ids").alias("doc_id"), F.col("x.sizes").cast("long").alias("n_words"))
    none = f"array<{kind.simpleString()}>"
    if hits is None:
        return docs.select("doc_id", "n_words", F.expr("CAST(array() AS array<struct<low: bigint, high: bigint>>)").alias("spans"), *[F.expr(f"CAST(array() AS {none})").alias(c) for c in ("items", "near_items")])
    gathered = hits.groupBy("shard", "doc").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items")])  # one row a block
    rows = docs.join(gathered, ["shard", "doc"], "left")
    joined = F.expr(
        "aggregate(array_sort(spans), CAST(array() AS array<struct<low: bigint, high: bigint>>), (a, s) -> CASE WHEN size(a) > 0 AND a[size(a) - 1].high >= s.low"
        " THEN concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].low AS low, greatest(a[size(a) - 1].high, s.high) AS high))) ELSE concat(a, array(s)) END)"
    ) if blocks > 1 else F.col("spans")
    rows = rows.withColumn("spans", joined)
    empty = {"spans": "array<struct<low: bigint, high: bigint>>", "items": none, "near_items": none}
    return rows.select("doc_id", "n_words", *[F.expr(f"coalesce({'spans' if c == 'spans' else f'array_sort(array_distinct({c}))'}, CAST(array() AS {t}))").alias(c) for c, t in empty.items()])


def report(found: DataFrame) -> DataFrame:
    """Per document: words, hit words, items with a window in it, the digest of their ids, and items with a window near by."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"),
    )


#: The registered query's twin: all windows of all documents, by equality of word lists.
SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}'), []) AS w FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}') AS w FROM benchmark WHERE text IS NOT NULL
), u AS (
    SELECT DISTINCT item_id, w[s : s + {WINDOW - 1}] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS s FROM i WHERE len(w) > 0)
), g AS (
    SELECT g, row_number() OVER () AS k FROM (SELECT DISTINCT g FROM u)
), o AS (
    SELECT r, s, k, n FROM (SELECT r, n, s, w[s : s + n - 1] AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT len(g) AS n FROM g))) JOIN g USING (g)
), hit AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM o) GROUP BY r
), item AS (
    SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM o JOIN g USING (k) JOIN u USING (g) WHERE item_id IS NOT NULL) GROUP BY r
), t AS (
    SELECT r, p, w[p] AS t FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), v AS (
    SELECT k, t, count(*) OVER (PARTITION BY k) AS n FROM (SELECT DISTINCT k, unnest(g) AS t FROM g)
), f AS (
    SELECT t, count(*) AS f FROM t GROUP BY t
), rare AS (
    SELECT k, t, n FROM v LEFT JOIN f USING (t) QUALIFY row_number() OVER (PARTITION BY k ORDER BY coalesce(f, 0), t) = 1
), x AS (
    SELECT rare.k, rare.n, t.r, t.p FROM rare JOIN t USING (t)
), y AS (
    SELECT x.k, x.n, x.r, x.p, z.p AS q, z.t FROM (SELECT k, n, r, p, unnest(range(p - {NEAR - 1}, p + {NEAR})) AS q FROM x) x
    JOIN t z ON z.r = x.r AND z.p = x.q JOIN v ON v.k = x.k AND v.t = z.t
), full_ AS (
    SELECT k, r, p FROM y GROUP BY k, r, p, n HAVING count(DISTINCT t) = n
), close AS (
    SELECT DISTINCT a.k, a.r FROM y a JOIN full_ USING (k, r, p) JOIN y b ON b.k = a.k AND b.r = a.r AND b.p = a.p AND b.q BETWEEN a.q AND a.q + {NEAR - 1}
    GROUP BY a.k, a.r, a.p, a.q, a.n HAVING count(DISTINCT b.t) = a.n
), near AS (
    SELECT r, count(DISTINCT item_id) AS n_near_items FROM close JOIN g USING (k) JOIN u USING (g) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r) LEFT JOIN near USING (r)
"""
