"""Periodic runs: stretches of words that repeat with a period, found in tiles of a scale.

A run is a stretch of words with smallest period q (words q apart are equal), at least
max(6, 4 q) words long, which no neighbouring word extends.  Equal words q apart are written as
intervals of positions i with word[i] = word[i + q]: a run from s with length n is the interval
[s, s + n - q), at least 3 q positions long.

Scale tiling.  Periods are dealt into octaves P <= q < 2 P, P = 1, 2, 4, ...  In an octave every
3 P-th word is an anchor, so the interval of every run holds an anchor, and the tile of an anchor c
is the words [c - 3 P, c + 5 P).  Tiles overlap and are solved alone: the Z-function of the
words from c on gives, for each q, how far words c, c + 1, ... equal those q later, and the Z-function
of the reversed words before c, against the reversed tile, gives the same backwards.  (Anchors
where no q fits the nearest few words need no Z-function: an interval of 3 P positions reaches at least
1.5 P to one side.)  An interval is cut at 3 P on either side; it leaves the tile if it was cut or is
long enough for a run, and if no proper divisor of q is a period of it (then q is not the smallest
period of any run around it; a stretch of more than 1.5 q words decides that exactly).

Documents of at most ``long_words`` words are tiled in the task that reads them.  Longer ones are
exploded to rows that hold the tiles of a piece of the document and an octave (fine octaves share a
piece), which are dealt out and solved like any others.  The cut intervals are shuffled by (document,
period) and stitched where they touch; whole runs are gathered by document, and the text is collapsed:
a word goes if a run contains it after the run's first q words.

No table holds all words of all documents: a task hands on the narrow rows, and the texts of those
documents only in which an interval was found.

Defined cases: a NULL text has no words; NULL and repeated ids are documents of their own; a document
without runs gives no runs, NULL for the longest one and its own words; empty tables give empty tables;
other columns are ignored.  A document's words and its runs (fewer than its words) fit into a task, as its text did.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import ship, text_bytes
from panelwright.session import stage

ship(__name__)

LEAST, EXPONENT = 6, 4
LONG_WORDS, TILE = 16_384, 16_384
ROWS, FLUSH = 256, 8 << 20
MARGIN = 6

SPANS = "array<struct<period: long, low: long, high: long>>"


def codes_of(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    return np.fromiter(map({}.setdefault, words, range(len(words))), np.int32, len(words))


def z_function(s: list, count: int) -> list[int]:
    """For each of the first ``count`` places, how many items from there on equal the first ones."""
    n = len(s)
    z = [0] * min(n, count)
    if z:
        z[0] = n
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def prime_divisors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] * (n > 1)


def _fitting(padded: np.ndarray, places: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the octave for which the nearest words on one side are equal a period apart.

    ``padded`` are the words' numbers between margins that equal no word.
    """
    p = 1 << octave
    near = min(MARGIN, (3 * p + 1) // 2)
    here = places + MARGIN
    at, q = np.nonzero(padded[here][:, None] == padded[here[:, None] + np.arange(p, 2 * p)])
    at, q = here[at], q + p
    keep = np.zeros(len(at), bool)
    for steps in (range(1, near), range(-1, -near - 1, -1)):
        left = np.arange(len(at))
        for step in steps:
            if not len(left):
                break
            i = at[left] + step
            left = left[padded[i] == padded[i + q[left]]]
        keep[left] = True
    return at[keep] - MARGIN, q[keep]


def solve_tile(codes: np.ndarray, place: int, octave: int, periods: list[int]) -> list[tuple[int, int, int]]:
    """(period, low, high) of the intervals around the anchor at ``place``; both ends within 3 P of it."""
    p = 1 << octave
    reach = 3 * p
    tile = codes[max(0, place - reach) : place + reach + 2 * p].tolist()
    before = min(place, reach)
    ahead = z_function(tile[before:], 2 * p)
    turned = tile[: before + 2 * p - 1][::-1]  # starts at the word furthest ahead
    width = len(turned) - before
    behind = z_function(tile[:before][::-1] + [-1] + turned, before + 1 + width)[before + 1 :] if before else [0] * width
    found = []
    for q in periods:
        forth, back = min(ahead[q], reach), min(behind[width - q], reach)
        if forth < reach and back < reach and forth + back + q < max(LEAST, EXPONENT * q):
            continue
        for prime in prime_divisors(q):
            d = q // prime
            if ahead[d] >= forth + q - d and behind[width - d] >= back:
                break  # a smaller period
        else:
            found.append((q, place - back, place + forth))
    return found


def stitched(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Intervals of one period that touch become one."""
    out: list[tuple[int, int, int]] = []
    for q, low, high in sorted(found):
        if out and out[-1][0] == q and low <= out[-1][2]:
            out[-1] = (q, out[-1][1], max(high, out[-1][2]))
        else:
            out.append((q, low, high))
    return out


def intervals(codes: np.ndarray, at: int, n: int, start: int, stop: int, lowest: int, highest: int) -> list[tuple[int, int, int]]:
    """(period, low, high) around all anchors in [start, stop) of a document of n words; ``codes`` begin at word ``at``."""
    found = []
    highest = min(highest, (n // EXPONENT).bit_length() - 1)
    padded = np.concatenate([np.full(MARGIN, -2, np.int32), codes, np.full((2 << max(0, highest)) + MARGIN, -1, np.int32)])
    for octave in range(lowest, highest + 1):
        step = 3 << octave
        places = np.arange(-(-start // step) * step, min(stop, n), step) - at
        if not len(places):
            continue
        place, q = _fitting(padded, places, octave)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else []
        for i, j in zip(first, [*first[1:], len(place)]):
            found += solve_tile(codes, int(place[i]), octave, q[i:j].tolist())
    return [(q, low + at, high + at) for q, low, high in stitched(found)]


def pieces(n: int, tile: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, stop, lowest, highest): the anchors and octaves of the rows that a long document is exploded to."""
    fine = max(0, (tile // 16).bit_length() - 1)
    for start in range(0, n, tile):
        yield start, min(n, start + tile), 0, fine
    octave = fine + 1
    while EXPONENT << octave <= n:
        yield from ((start, start + 1, octave, octave) for start in range(0, n, 3 << octave))
        octave += 1


def _measured(docs: DataFrame, id_col: str, text_col: str, edit: Callable | None, texts: bool, long_words: int) -> DataFrame:
    """row, doc_id, n_words, whole (digest of the words), spans, body, codes; staged."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for from_row in range(0, max(1, batch.num_rows), ROWS):
                part = batch.slice(from_row, ROWS)
                made, held, ids = [], 0, 0
                for doc_id, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1))):
                    words = text.split()
                    if edit is not None:
                        words = edit(doc_id, words)
                    codes = codes_of(words)
                    n = len(words)
                    long = n > long_words
                    spans = [] if long else intervals(codes, 0, n, 0, n, 0, n.bit_length())
                    whole = b" ".join(words)
                    body = whole if spans or long or texts else None
                    made.append((n, hashlib.sha256(whole).hexdigest(), [{"period": q, "low": s, "high": e} for q, s, e in spans], body, codes.tobytes() if long else None))
                    held += len(body or b"") + 4 * n * long
                    if held > FLUSH:
                        yield _batch(part.column(0).slice(ids, len(made)), made)
                        made, held, ids = [], 0, ids + len(made)
                yield _batch(part.column(0).slice(ids, len(made)), made)

    def _batch(ids, made):
        columns = list(zip(*made)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([(c, pa.int64()) for c in ("period", "low", "high")])), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([ids] + [pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_words", "whole", "spans", "body", "codes"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(run, f"doc_id {kind}, n_words long, whole string, spans {SPANS}, body binary, codes binary")
    return stage(rows.withColumn("row", F.monotonically_increasing_id()))


def _long_intervals(measured: DataFrame, tile: int) -> DataFrame:
    """row, period, low, high of the documents that are longer than a task should solve."""

    def cut(batches):
        for batch in batches:
            for row, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                codes = np.frombuffer(raw, np.int32)
                for start, stop, lowest, highest in pieces(n, tile):
                    at, end = max(0, start - (3 << highest)), min(n, stop + (5 << highest))
                    yield pa.RecordBatch.from_pylist([{"row": row, "n": n, "at": at, "start": start, "stop": stop, "lowest": lowest, "highest": highest, "codes": codes[at:end].tobytes()}])

    def solve(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                found = intervals(np.frombuffer(x["codes"], np.int32), x["at"], x["n"], x["start"], x["stop"], x["lowest"], x["highest"])
                columns = list(zip(*found)) or [[]] * 3
                arrays = [pa.array([x["row"]] * len(found), pa.int64())] + [pa.array(c, pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "period", "low", "high"])

    long = measured.filter("codes IS NOT NULL").select("row", "n_words", "codes")
    rows = long.mapInArrow(cut, "row long, n long, at long, start long, stop long, lowest long, highest long, codes binary")
    return rows.repartition("row", "start", "lowest").mapInArrow(solve, "row long, period long, low long, high long")


def stitch(cut: DataFrame) -> DataFrame:
    """row, start, length, period of the runs, from cut intervals (row, period, low, high)."""
    order = Window.partitionBy("row", "period").orderBy("low", "high")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("opens", F.when(reached >= F.col("low"), 0).otherwise(1))
    cut = cut.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = cut.groupBy("row", "period", "run").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    whole = whole.select("row", "start", (F.col("high") - F.col("start") + F.col("period")).alias("length"), "period")
    return whole.filter(F.col("length") >= F.greatest(F.lit(LEAST), EXPONENT * F.col("period")))


def collapse(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable | None = None, digest: bool = False,
    long_words: int = LONG_WORDS, tile: int = TILE,
) -> DataFrame:
    """doc_id, n_words, runs (start, period, length, in this order) and the words that stay, joined by one space.

    ``edit(id, words)`` may change a document's words first.  With ``digest`` the column ``collapsed`` is the
    SHA-256 of the words that stay, and texts without repeats are never carried along.
    """
    measured = _measured(docs, id_col, text_col, edit, not digest, long_words)
    short = measured.select("row", F.explode("spans").alias("s")).select("row", "s.period", "s.low", "s.high")
    runs = stitch(short.unionByName(_long_intervals(measured, tile)))
    runs = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    rows = measured.select("row", "doc_id", "n_words", "whole", "body").join(runs, "row", "left")

    def run(batches):
        for batch in batches:
            for from_row in range(0, max(1, batch.num_rows), ROWS):
                part = batch.slice(from_row, ROWS)
                out = []
                for whole, body, found in zip(*(part.column(i).to_pylist() for i in (2, 3, 4))):
                    text = body
                    if found:
                        words = body.split(b" ")
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, [r["start"] + r["period"] for r in found], 1)
                        np.add.at(change, [r["start"] + r["length"] for r in found], -1)
                        text = b" ".join(compress(words, (np.cumsum(change)[:-1] == 0).tolist()))
                    if digest:
                        text = hashlib.sha256(text).hexdigest() if found else whole
                    else:
                        text = text.decode()
                    out.append(text)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in (0, 1, 4)] + [pa.array(out, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = rows.select("doc_id", "n_words", "whole", "body", F.coalesce("runs", F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")).alias("runs"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, period: long, length: long>>, collapsed string")


def report(collapsed: DataFrame) -> DataFrame:
    """Per document: the number of runs, the longest one (ties: first start, then period) and both digests."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = collapsed.withColumn("longest", longest)
    start, length, period = -F.col("longest.s"), F.col("longest.n"), -F.col("longest.p")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"), "n_words",
    )
