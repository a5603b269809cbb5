"""Near-duplicates by a MinHash LSH forest.

A document's set are the 64-bit hashes of its distinct word shingles.  Documents with equal sets
become one node first.  A node has TREES short signatures of DEPTH MinHash values; each tree is
the order of all nodes by that signature.  Neighbours in an order share the longest prefixes, so
the next WIDTH nodes of each place are candidates as long as the shared prefix has FLOOR values:
where few nodes share a prefix the candidates go down to the floor, and where many do, the order
itself goes deeper.  The orders are range-partitioned by signature and node, so that no bucket
has to fit in one task; the edges of the partitions are paired separately.

Links are confirmed on the full sets.  To keep that cheap, it goes by rounds: first the closest
candidate of each node, then all candidates between different components, then hubs: in each
bucket of a tree that still holds several components, every member of another component meets the
bucket's member with most close candidates.  Hub rounds end when they bring no new link.  The
rounds so far only join components early; what decides is the last part: in each bucket (equal
floor prefix) that still holds several components, every pair of nodes of different components is
compared, in cells of at most about 2 BLOCK nodes, so that a crowded bucket is spread over tasks.
No pair becomes a row there.  First ``close_places`` marks the places of nodes that a 128-bit sketch
(one bit of each MinHash value) and the MinHash values themselves put within six standard deviations
of the threshold of another, in the first tree in which the two share a bucket.  Then ``joining_links``
brings the full sets to the marked places, once a place and cell, confirms every close pair there
unless links already found in the task join it, and returns the links that join components: at most one
less than a task has components.

At a similarity of 0.85 a pair shares the floor prefix in one of 16 trees but for a chance of
2e-7 (0.8: 1e-5).

Defined cases: NULL text counts as empty; an empty set is linked with nothing; fewer words than a
shingle form one shingle; rows that share an id are one document for linking, with a result row
each; NULL ids are linked with nothing (component NULL, kept); an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import row_of, ship, text_bytes, unpacked
from panelwright.session import stage

ship(__name__)

TREES = 16
DEPTH = 8
FLOOR = 3
WIDTH = 1
BLOCK = 2048
#: Set members of a block, where the sets travel.
ITEMS = 1 << 20
#: Close pairs a task holds before it confirms them.
HELD = 1 << 18
SEED = 97
MASK_BITS = 1 << 22
BITS = TREES * DEPTH


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z are lower-cased."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(codes))
    key = np.full(len(codes) - size + 1, size, np.uint64)
    for k in range(size):
        key = (key ^ codes[k : len(codes) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return np.unique(key)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 2**63, BITS, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, BITS, np.uint64)


def minhash(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 2048):
        part = items[at : at + 2048, None] * a
        part += b
        np.minimum(low, part.min(0), out=low)
    return low


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, s1, s2 (128-bit identity of the set), signature and sketch (NULL for empty sets)."""
    def run(batches):
        import xxhash

        a, b = _multipliers()
        for batch in batches:
            sizes, one, two, signs, sketches = [], [], [], [], []
            for text in text_bytes(batch.column(1)):
                items = shingle_set(text, words)
                sizes.append(len(items))
                mark = xxhash.xxh3_128_digest(items.tobytes())
                one.append(int.from_bytes(mark[:8], "little", signed=True))
                two.append(int.from_bytes(mark[8:], "little", signed=True))
                if not len(items):
                    signs.append(None)
                    sketches.append((None, None))
                    continue
                low = minhash(items, a, b)
                signs.append((low >> np.uint64(3)).astype(">u2").tobytes())
                sketches.append(np.packbits(((low >> np.uint64(20)) & np.uint64(1)).astype(bool)).view("<i8").tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(signs, pa.binary()),
                 pa.array([x for x, _ in sketches], pa.int64()), pa.array([y for _, y in sketches], pa.int64())],
                names=["doc_id", "n", "s1", "s2", "signature", "b1", "b2"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, signature binary, b1 long, b2 long")


def forest(nodes: DataFrame) -> DataFrame:
    """Each node once per tree, with the tree's signature as two numbers (k1 holds the first half)."""
    rows = nodes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))

    def run(batches):
        for batch in batches:
            trees = batch.column(4).to_numpy()
            raw = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, TREES, DEPTH * 2)
            keys = np.ascontiguousarray(raw[np.arange(len(trees)), trees]).view(">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(4), pa.array(keys[:, 0]), pa.array(keys[:, 1]), *batch.columns[:4]], names=["tree", "k1", "k2", "node", "n", "b1", "b2"],
            )

    return rows.select("node", "n", "b1", "b2", "tree", "signature").mapInArrow(run, "tree int, k1 long, k2 long, node long, n long, b1 long, b2 long")


def _far(percent: int) -> int:
    """Sketch bits that may differ at the threshold, plus six standard deviations."""
    p = (1 - percent / 100) / 2
    return int(BITS * p + 6 * math.sqrt(BITS * p * (1 - p)))


def _alike(percent: int) -> int:
    """MinHash values that agree at the threshold, less six standard deviations."""
    p = percent / 100
    return math.ceil(BITS * p - 6 * math.sqrt(BITS * p * (1 - p)))


def neighbours(order: DataFrame, percent: int, width: int = WIDTH) -> DataFrame:
    """Candidate pairs (a < b, far) of a forest: near places of an order, not of the same ``label``.

    The edges of partitions are paired as well.
    """
    far = _far(percent)
    columns = ["tree", "k1", "k2", "deeper", "node", "n", "b1", "b2", "label"]

    def edge(rows):
        return pa.RecordBatch.from_arrays([pa.nulls(len(rows[0]), pa.int64())] * 3 + [pa.array(c) for c in rows], names=["a", "b", "far", *columns])

    def run(batches, edges: bool):
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy().astype(np.int64) for c in batch.columns]
            if first and edges:
                yield edge([c[:width] for c in now])
            first = False
            rows = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            start = 0 if held is None else len(held[0])
            tree, k1, _, _, node, n, b1, b2, label = rows
            bucket = k1 >> 16  # the floor prefix
            size = len(tree)
            found = []
            for lag in range(1, min(width, size - 1) + 1):
                low = max(start, lag)
                y = np.flatnonzero((bucket[low - lag : size - lag] == bucket[low:]) & (tree[low - lag : size - lag] == tree[low:]) & (label[low - lag : size - lag] != label[low:])) + low
                x = y - lag
                fits = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
                x, y = x[fits], y[fits]
                apart = np.bitwise_count((b1[x] ^ b1[y]).view(np.uint64)).astype(np.int64) + np.bitwise_count((b2[x] ^ b2[y]).view(np.uint64))
                close = apart <= far
                x, y = x[close], y[close]
                found.append(np.column_stack([x, y, apart[close]]))
            x, y, apart = np.concatenate(found).T if found else np.zeros((3, 0), np.int64)
            pairs = np.unique(np.column_stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), apart]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(3)] + [pa.nulls(len(pairs), pa.int64())] * len(columns), names=["a", "b", "far", *columns])
            held = [c[-width:] for c in rows]
        if held is not None and edges:
            yield edge(held)

    schema = "a long, b long, far long, tree long, k1 long, k2 long, deeper long, node long, n long, b1 long, b2 long, label long"
    keys = ["tree", "k1", "k2", "deeper", "node"]
    # where whole signatures agree the order goes on with the sketch, from another bit in each tree
    turn = (F.col("tree") % 8 * 8).cast("int")
    word = F.when(F.col("tree") < 8, F.col("b1")).otherwise(F.col("b2"))
    deeper = F.call_function("shiftleft", word, turn).bitwiseOR(F.call_function("shiftrightunsigned", word, 64 - turn))
    ranged = order.withColumn("deeper", deeper).select(*columns).repartitionByRange(*keys).sortWithinPartitions(*keys)
    made = stage(ranged.mapInArrow(lambda b: run(b, True), schema))
    # at most twice the width for each partition of the order
    rest = made.filter("a IS NULL").select(*columns).distinct().coalesce(1).sortWithinPartitions(*keys)
    rest = rest.mapInArrow(lambda b: run(b, False), schema)
    return made.filter("a IS NOT NULL").select("a", "b", "far").unionByName(rest.select("a", "b", "far")).groupBy("a", "b").agg(F.min("far").alias("far"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node of each component.

    Every round, a node and the node that labels it take the smallest label among the node's
    links, and labels jump to their own labels, so the rounds grow with the logarithm of the
    longest chain.  ``labels`` may hold the components of earlier links; nodes without links are not listed.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    start = both.select(F.col("a").alias("node")).distinct()
    if labels is not None:
        old = labels.select("node", "label")
        start = start.join(old, "node", "left").select("node", F.coalesce("label", "node").alias("label")).unionByName(
            old.join(both.select(F.col("a").alias("node")), "node", "left_anti"))
        # links lead between earlier components
        heads = old.select(F.col("node").alias("a"), F.col("label").alias("la"))
        to = old.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        lifted = both.join(heads, "a", "left").join(to, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b")
        both = both.unionByName(lifted).distinct()
    else:
        start = start.withColumn("label", F.col("node"))
    both, labels = stage(both), stage(start)
    while True:
        passed = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "label")
        none = F.lit(None).cast("long")
        lower = labels.select("node", "label", F.col("label").alias("was")).unionByName(passed.withColumn("was", none)).groupBy("node").agg(
            F.min("label").alias("label"), F.max("was").alias("was"))
        hooks = F.array(F.struct("node", "label", "was"), F.struct(F.col("was").alias("node"), "label", none.alias("was")))
        lower = stage(lower.select(F.explode(hooks).alias("x")).select("x.*").filter("node IS NOT NULL").groupBy("node").agg(
            F.min("label").alias("label"), F.max("was").alias("was")))
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = stage(lower.join(up, "label").select("node", F.col("top").alias("label"), "was"))
        labels = jumped.select("node", "label")
        if jumped.filter("was IS NULL OR label <> was").isEmpty():
            return labels


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    rows = pairs.join(left, "a", "left").join(right, "b", "left")
    return rows.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def crowded(order: DataFrame) -> DataFrame:
    """The places of an order whose bucket holds several nodes: tree, bucket, node, n, b1, b2."""
    rows = order.select("tree", F.shiftright("k1", 16).alias("bucket"), "node", "n", "b1", "b2")
    several = rows.groupBy("tree", "bucket").count().filter("count > 1")
    return rows.join(several, ["tree", "bucket"], "left_semi")


def _cells(places: DataFrame, labels: DataFrame, items: int | None = None) -> DataFrame:
    """The places of buckets with several components, each in all its cells: tree, bucket, ca, cb, block, node, n, b1, b2, label.

    The nodes of a bucket fall into blocks, those of its largest component into blocks of their
    own; a cell is a pair of blocks, without those of the largest component with itself.  With
    ``items`` a block is kept to about that many set members as well.
    """
    rows = stage(places.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    counts = rows.groupBy("tree", "bucket", "label").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("items"))
    top = counts.groupBy("tree", "bucket").agg(
        F.sum("count").alias("count"), F.sum("items").alias("items"), F.max(F.struct("count", "label", "items")).alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")

    def blocks(count, size):
        by_count = F.ceil(count / BLOCK)
        return (by_count if items is None else F.greatest(by_count, F.ceil(size / items))).cast("long")

    small = blocks(F.col("count"), F.col("items")) <= 2
    # a small bucket is one block
    top = stage(top.select(
        "tree", "bucket", F.when(~small, F.col("main.label")).alias("main"), F.when(small, 0).otherwise(blocks(F.col("main.count"), F.col("main.items"))).cast("long").alias("mains"),
        F.when(small, 1).otherwise(blocks(F.col("count") - F.col("main.count"), F.col("items") - F.col("main.items"))).cast("long").alias("others"),
    ))
    mine = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
    rows = rows.join(top, ["tree", "bucket"]).withColumn("block", F.when(mine, F.col("others") + F.pmod(F.xxhash64("node"), "mains")).otherwise(F.pmod(F.xxhash64("node"), "others")))
    met = F.sequence(F.lit(0).cast("long"), F.when(mine, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))
    cells = F.transform(met, lambda k: F.struct(F.least(k, "block").alias("ca"), F.greatest(k, "block").alias("cb")))
    return rows.withColumn("cell", F.explode(cells)).select("tree", "bucket", "cell.ca", "cell.cb", "block", "node", "n", "b1", "b2", "label")


def _by_cell(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """What ``kernel`` makes of tables of whole cells."""
    key = ["tree", "bucket", "ca", "cb"]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            last = [now.column(k)[-1] for k in range(4)]
            whole = np.ones(now.num_rows, bool)
            for k in range(4):
                whole &= now.column(k).to_numpy() == last[k].as_py()
            cut = now.num_rows - int(whole.sum())
            if cut:
                yield kernel(now.slice(0, cut))
            held = now.slice(cut)
        if held is not None:
            yield kernel(held)

    return rows.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(run, schema)


def _close(rows: pa.Table, percent: int):
    """Rows i, j of close nodes of different components in a cell, each pair in the first tree in which it shares a bucket."""
    tree, bucket, ca, cb, block, node, n, b1, b2, label = (c.to_numpy() for c in rows.columns[:10])
    sign = np.frombuffer(b"".join(rows.column(10).to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)
    size, least, far = len(node), _alike(percent), _far(percent)
    new = np.ones(size, bool)
    new[1:] = (tree[1:] != tree[:-1]) | (bucket[1:] != bucket[:-1]) | (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])
    room = np.arange(size) - np.flatnonzero(new)[np.cumsum(new) - 1]  # places of the cell before this one
    split = ca != cb  # two blocks, each of which has a cell of its own
    y, lag = np.arange(size), 0
    while True:
        lag += 1
        y = y[room[y] >= lag]
        if not len(y):
            return
        x = y - lag
        keep = (label[x] != label[y]) & (~split[y] | (block[x] != block[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        i, j = x[keep], y[keep]
        apart = np.bitwise_count((b1[i] ^ b1[j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((b2[i] ^ b2[j]).view(np.uint64))
        keep = apart <= far
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        same = sign[i] == sign[j]
        keep = (same.sum((1, 2)) >= least) & (same[:, :, :FLOOR].all(2).argmax(1) == tree[i])
        if keep.any():
            yield i[keep], j[keep]


def close_places(places: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The places that hold a node of a close pair of different components."""
    def marked(rows: pa.Table) -> pa.RecordBatch:
        near = np.zeros(rows.num_rows, bool)
        for i, j in _close(rows, percent):
            near[i] = near[j] = True
        found = rows.select([0, 1, 5]).filter(pa.array(near)).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array(c.to_numpy()) for c in found.columns], names=["tree", "bucket", "node"])

    rows = _cells(places, labels).join(nodes.select("node", "signature"), "node").select("tree", "bucket", "ca", "cb", "block", "node", "n", "b1", "b2", "label", "signature")
    found = _by_cell(rows, marked, "tree int, bucket long, node long").distinct()
    return places.join(found, ["tree", "bucket", "node"], "left_semi")


def _joined(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Links of full sets that join the components met in whole cells: every close pair not joined by them is too far apart."""
    node, known = rows.column(5).to_numpy(), {}
    # rows that share an id may differ in text, so a set is told by its members
    which = np.array([known.setdefault(x, len(known)) for x in rows.column(11).to_pylist()], np.int64)
    _, codes = np.unique(np.frombuffer(b"".join(known), "<u8"), return_inverse=True)
    codes, size = codes.astype(np.int32), np.array([len(x) // 8 for x in known], np.int64)
    ends = np.cumsum(size).tolist()
    sets = [codes[a:b] for a, b in zip([0, *ends], ends)]
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 0, bool)
    _, kind = np.unique(rows.column(9).to_numpy(), return_inverse=True)
    head = np.arange(len(kind))  # what stands for each component of the rows
    links, held, count = [], [], 0

    def confirm():
        pairs = np.concatenate(held, axis=1)
        pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
        starts = np.flatnonzero(np.r_[True, pairs[0, 1:] != pairs[0, :-1]])
        for a, b in zip(starts, [*starts[1:], pairs.shape[1]]):
            i, j = pairs[0, a], pairs[1, a:b]
            j = j[head[kind[j]] != head[kind[i]]]
            if not len(j):
                continue
            others = [sets[k] for k in which[j]]
            mark[sets[which[i]]] = True
            shared = np.add.reduceat(mark[np.concatenate(others)], np.cumsum([0] + [len(x) for x in others[:-1]]), dtype=np.int64)
            mark[sets[which[i]]] = False
            for k in j[100 * shared >= percent * (size[which[i]] + size[which[j]] - shared)]:
                one, two = head[kind[i]], head[kind[k]]
                if one != two:
                    head[head == two] = one
                    links.append((min(node[i], node[k]), max(node[i], node[k])))

    for i, j in _close(rows, percent):
        held.append(np.stack([i, j]))
        count += len(i)
        if count >= HELD:
            confirm()
            held, count = [], 0
    if held:
        confirm()
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def joining_links(places: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a < b) that join all components between which the places' buckets hold a link."""
    rows = _cells(places, labels, ITEMS).join(nodes.select("node", "signature"), "node").join(sets.select("node", "items"), "node")
    rows = rows.select("tree", "bucket", "ca", "cb", "block", "node", "n", "b1", "b2", "label", "signature", "items")
    return _by_cell(rows, lambda table: _joined(table, percent), "a long, b long").distinct()


def _hub_pairs(places: DataFrame, pairs: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """In every bucket with several components: each member of another component with the hub.

    The hub is the member with most candidates that look similar enough: an original among its
    copies is nearer to each of them than they are to each other.
    """
    close = pairs.filter(F.col("far") <= int(BITS * (1 - percent / 100) / 2))
    ends = close.select(F.col("a").alias("node")).unionAll(close.select(F.col("b").alias("node"))).groupBy("node").count()
    known = stage(labels.join(ends, "node", "left").select("node", "label", F.col("count").alias("degree")))
    rows = places.join(known, "node", "left").select(
        "tree", "bucket", "node", "n", "b1", "b2", F.coalesce("label", "node").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"),
    )
    rows = stage(rows)
    top = rows.groupBy("tree", "bucket").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("degree", "node", "label", "n", "b1", "b2")).alias("hub"),
    ).filter("lo <> hi AND hub.degree > 0").select("tree", "bucket", "hub")
    top = stage(top)
    met = rows.join(top, ["tree", "bucket"]).filter("label <> hub.label")
    met = met.filter((F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent) & (
        F.bit_count(F.col("b1").bitwiseXOR(F.col("hub.b1"))) + F.bit_count(F.col("b2").bitwiseXOR(F.col("hub.b2"))) <= _far(percent)))
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id linked, directly or not), kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(signatures(docs, words))
    full = rows.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = stage(full.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("b1").alias("b1"), F.first("b2").alias("b2")))
    order = stage(forest(nodes))
    pairs = stage(neighbours(order.withColumn("label", F.col("node")), percent))
    places = stage(crowded(order))
    labels = nodes.filter(F.lit(False)).select("node", F.col("node").alias("label"))
    tried = sets = None

    def linked(new: DataFrame) -> bool:
        """Confirm the pairs not tried before; whether a link came."""
        nonlocal tried
        new = stage(new.select("a", "b") if tried is None else new.select("a", "b").join(tried, ["a", "b"], "left_anti"))
        if new.isEmpty():
            return False
        tried = new if tried is None else tried.unionByName(new)
        fetch(new.select(F.col("a").alias("node")).unionAll(new.select(F.col("b").alias("node"))).distinct())
        return joined(confirmed(new, sets, percent))

    def fetch(wanted: DataFrame) -> None:
        """The sets of the candidates only, from their texts."""
        nonlocal sets
        missing = stage(wanted if sets is None else wanted.join(sets, "node", "left_anti"))
        if not missing.isEmpty():
            more = stage(item_sets(docs, missing, words))
            sets = more if sets is None else sets.unionByName(more)

    def joined(found: DataFrame) -> bool:
        nonlocal labels
        links = stage(found)
        if links.isEmpty():
            return False
        labels = components(links, labels)
        return True

    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "far"))
    linked(ends.groupBy("a").agg(F.min(F.struct("far", "b")).alias("x")).select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct())
    linked(_between(pairs, labels))
    while linked(_hub_pairs(places, pairs, labels, percent)):
        pass
    near = stage(close_places(places, nodes, labels, percent))
    if not near.isEmpty():
        fetch(near.select("node").distinct())
        joined(joining_links(near, nodes, sets, labels, percent))
    named = nodes.select("s1", "s2", "node")
    named = stage(named.join(labels, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("component")))
    out = rows.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def item_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, items (the sorted set as little-endian 64-bit numbers) of the documents in ``wanted``.

    A bit mask of fixed size over hashed ids tells tasks which texts may be wanted, so that few
    others are hashed and moved; the join decides.
    """
    place = F.xxhash64("node").bitwiseAND(F.lit(MASK_BITS - 1))
    cells = wanted.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    cells = cells.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most MASK_BITS / 64 rows
    mask = np.zeros(MASK_BITS // 64, np.int64)
    mask[cells.word.to_numpy(np.int64)] = cells.bits.to_numpy(np.int64)

    def run(batches):
        bits = mask.view(np.uint64)
        for batch in batches:
            at = batch.column(2).to_numpy().astype(np.uint64) & np.uint64(MASK_BITS - 1)
            maybe = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            batch = batch.filter(pa.array(maybe))
            made = [shingle_set(text, words).astype("<u8").tobytes() for text in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "items"])

    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("at"))
    return rows.mapInArrow(run, "node long, items binary").join(wanted, "node", "left_semi")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component, all rows without an id among them.

    Rows that share an id and differ in text are documents of their own here; of rows that agree in both one stays.
    """
    own = docs.groupBy(F.col(id_col).alias("i")).agg(F.countDistinct(F.xxhash64(text_col)).alias("n")).filter("i IS NOT NULL AND n > 1")
    if not own.isEmpty():
        rows = stage(docs.filter(F.col(id_col).isNotNull()).select(row_of(docs)).withColumn("at", F.monotonically_increasing_id()))
        texts = rows.select("at", F.col("row").getField(text_col).alias("text"))
        groups = near_duplicates(texts, "at", "text", words, percent).select(F.col("doc_id").alias("at"), "component_id")
        named = rows.select("at", F.col("row").getField(id_col).alias("i")).join(groups, "at")
        kept = named.groupBy("component_id").agg(F.min(F.struct("i", "at")).alias("x")).select(F.col("x.at").alias("at"))
        return rows.join(kept, "at", "left_semi").select(*unpacked(docs.columns)).unionByName(docs.filter(F.col(id_col).isNull()))
    kept = near_duplicates(docs, id_col, text_col, words, percent).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept")).distinct()
    rows = docs.filter(F.col(id_col).isNotNull()).select(row_of(docs), F.col(id_col).alias("own"))
    rows = rows.join(kept, F.col("own") == F.col("__kept"), "left_semi").dropDuplicates(["own"])
    return rows.select(*unpacked(docs.columns)).unionByName(docs.filter(F.col(id_col).isNull()))


#: Exact, by an inverted index; for small tables.
SQL = """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(shingle) AS h FROM (
        SELECT doc_id, ws[i : i + 2] AS shingle FROM (SELECT *, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)
        UNION ALL SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND 2)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_n >= 85 * (p.n + q.n - both_n)),
    l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    c(doc_id, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.label FROM c JOIN l ON l.a = c.doc_id WHERE c.label < l.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(label) AS component_id FROM c GROUP BY 1) m USING (doc_id)"""
