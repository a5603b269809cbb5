"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Encoding follows the BPE agenda: of all adjacent pairs whose concatenation is a piece, the one
with the best score (leftmost at ties) merges first.  With dropout each candidate merge that comes up
is skipped with probability ``rate``; a skipped candidate never comes back.  Skips are drawn for every
word of every document: a keyed hash of (seed, document id, place of the word) gives the number of
candidates that merge before the first skip, before the second and so on (geometric, which is a draw for
each candidate).  Segmentations therefore depend on the key alone, not on partitions, batches or retries.

No piece holds a word mark after another character (checked when the model is read), so merges
never cross the start of a word.  A segmentation follows from the word and the candidates that are skipped, so
these are memoised once a task as a tree of bounded size: a word without skips, below it the word with
one skip, and so on.  Words are segmented together as numpy matrices, long ones by a heap for each occurrence.

Characters outside the vocabulary, and the word mark itself when it stands in a text, become byte
pieces, so ``decode(encode(text)) == text`` for every text.  Rate 0 gives the library's encoding.

Defined cases: NULL and empty texts have no ids; a NULL document id counts as 0 in the key;
repeated rows encode alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import ship

ship(__name__)

MARK = "▁"
RATE = 0.1
SEED = 20260
MEMO = 1_500_000
LONG = 48
BLOCK = 2048
PAD = -(1 << 30)
NEVER = 1 << 40


class Model:
    """Pieces, merges and byte pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        if size > 65_536:
            raise ValueError("ids of more than 16 bits")
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece crosses a word start")
        self.id_of = {self.pieces[i]: i for i in plain}
        self.byte_id = np.zeros(256, np.uint16)
        self.output = [b""] * size
        for i in range(size):
            if sp.is_byte(i):
                code = int(self.pieces[i][3:5], 16)
                self.byte_id[code], self.output[i] = i, bytes([code])
        for i in plain:
            self.output[i] = self.pieces[i].replace(MARK, " ").encode()
        self.two = [bytes((i & 255, i >> 8)) for i in range(size)]
        self.unknown: dict[int, bytes] = {}
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        # by code point: the piece of a character; outside the vocabulary -1 - code point
        self.symbol_of = -1 - np.arange(0x110000, dtype=np.int64)
        for piece, i in self.id_of.items():
            if len(piece) == 1 and piece != MARK:
                self.symbol_of[ord(piece)] = i
        if MARK in self.id_of:
            self.symbol_of[ord(" ")] = self.id_of[MARK]
        # merges: rank 0 is best
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        pairs = [
            (self.id_of[a] << 16 | self.id_of[b], rank[i], i)
            for i in plain for cut in range(1, len(self.pieces[i]))
            if (a := self.pieces[i][:cut]) in self.id_of and (b := self.pieces[i][cut:]) in self.id_of
        ]
        self.merge = {key: (r, i) for key, r, i in pairs}
        self.bits = 21
        self.table = np.full((1 << self.bits, 3), -1, np.int64)
        self.probes = 1
        for row in pairs:
            at = int(self._slot(np.array([row[0]]))[0])
            step = 1
            while self.table[at, 0] >= 0:
                at, step = (at + 1) % (1 << self.bits), step + 1
            self.table[at] = row
            self.probes = max(self.probes, step)

    def spelt(self, symbol: int) -> bytes:
        """The byte pieces of a character outside the vocabulary."""
        if symbol not in self.unknown:
            self.unknown[symbol] = self.byte_id[list(chr(-1 - symbol).encode())].astype("<u2").tobytes()
        return self.unknown[symbol]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; rank -1 where there is none.  Pieces below 0 never merge."""
        keys = (left << 16) | right
        keys[(left < 0) | (right < 0)] = -2
        shape, keys = keys.shape, keys.ravel()
        rank, piece = np.full(keys.shape, -1, np.int64), np.full(keys.shape, -1, np.int64)
        slot, at = self._slot(keys), None
        for step in range(self.probes):
            rows = self.table[(slot + step) & ((1 << self.bits) - 1)]
            hit = np.flatnonzero(rows[:, 0] == keys)
            found = hit if at is None else at[hit]
            rank[found], piece[found] = rows[hit, 1], rows[hit, 2]
            # an empty slot ends the search; few keys go on
            on = np.flatnonzero((rows[:, 0] != keys) & (rows[:, 0] >= 0) & (keys >= 0))
            if not len(on):
                break
            at, keys, slot = on if at is None else at[on], keys[on], slot[on]
        rank, piece = rank.reshape(shape), piece.reshape(shape)
        return rank, piece


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(start, step) -> np.ndarray:
    """64-bit keys of the steps from each start."""
    with np.errstate(over="ignore"):
        return _mixed(np.asarray(start, np.uint64) + (np.asarray(step).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _gaps(keys, k, rate: float) -> np.ndarray:
    """How many candidates merge between skip ``k`` of each key and the one before."""
    if rate <= 0:
        return np.full(np.shape(keys), NEVER, np.int64)
    u = (_keys(keys, k) >> np.uint64(11)).astype(np.float64) / 2**53
    with np.errstate(divide="ignore"):
        return np.minimum(np.log1p(-u) / np.log1p(-rate), NEVER).astype(np.int64)


def _ids(model: Model, row: list[int]) -> bytes:
    return b"".join([model.two[piece] if piece >= 0 else model.spelt(piece) for piece in row])


def agenda(model: Model, word: str, variant: int, seed: int, rate: float) -> bytes:
    """Segment one word with a heap; the plain form of ``together``."""
    return _agenda(model, word, int(_keys(np.uint64(seed & (2**63 - 1)), variant)), rate)


def _agenda(model: Model, word: str, key: int, rate: float) -> bytes:
    pieces = model.symbol_of[np.frombuffer(word.encode("utf-32-le"), "<u4")].tolist()
    n = len(pieces)
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap: list[tuple] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and pieces[i] >= 0 and pieces[j] >= 0 and (found := model.merge.get(pieces[i] << 16 | pieces[j])):
            heapq.heappush(heap, (found[0], i, j, pieces[i], pieces[j], found[1]))

    def gaps():
        for first in itertools.count(0, 64):
            yield from _gaps(np.full(64, key, np.uint64), np.arange(first, first + 64), rate).tolist()

    for i in range(n - 1):
        offer(i)
    draws = gaps()
    left = next(draws)  # candidates before the next skip
    while heap:
        _, i, j, one, two, made = heapq.heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and pieces[i] == one and pieces[j] == two):
            continue
        if not left:
            left = next(draws)
            continue
        left -= 1
        pieces[i], alive[j], after[i] = made, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return _ids(model, [p for p, live in zip(pieces, alive) if live])


def together(model: Model, words: list[str], variants: list[int], seed: int, rate: float) -> list[bytes]:
    """Segment many words at once: every round merges the best candidate of each word."""
    keys = _keys(np.uint64(seed & (2**63 - 1)), np.array(variants, np.int64))
    short = [i for i, word in enumerate(words) if len(word) <= LONG]
    made, _ = _segmented(model, [words[i] for i in short], lambda i, k: _gaps(keys[np.array(short)[i]], k, rate))
    out = dict(zip(short, made))
    return [out[i] if i in out else _agenda(model, word, int(keys[i]), rate) for i, word in enumerate(words)]


def _segmented(model: Model, words: list[str], gap) -> tuple[list[bytes], list[int]]:
    """Ids of each word, and how many candidates merged after its last skip; ``gap(i, k)`` counts those before skip k of word i."""
    out, last = [b""] * len(words), [0] * len(words)
    by_width: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        if word:
            by_width.setdefault(len(word) + 3 & ~3, []).append(i)
    none = 1 << 40
    for width, where in by_width.items():
        live = np.array(where)
        skips, merged, due = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), gap(live, np.zeros(len(live), np.int64))
        sizes = np.fromiter((len(words[i]) for i in where), np.int64, len(where))
        codes = np.frombuffer("".join([words[i] for i in where]).encode("utf-32-le"), "<u4")
        pieces = np.full((len(where), width), PAD, np.int64)
        pieces[np.arange(width) < sizes[:, None]] = model.symbol_of[codes]

        def candidates(left, right):
            rank, made = model.lookup(left, right)
            rank[rank < 0] = none
            return rank, made

        rank, made = candidates(pieces[:, :-1], pieces[:, 1:])
        while True:
            width = pieces.shape[1]
            if width > 1:
                best = rank.argmin(1)  # the leftmost of the best
                rows = np.arange(len(live))
                done = rank[rows, best] == none
                at = np.flatnonzero((merged == due) & ~done)
                while len(at):  # these candidates are skipped, the next ones take their place
                    rank[at, best[at]] = none
                    skips[at] += 1
                    merged[at], due[at] = 0, gap(live[at], skips[at])
                    best[at] = rank[at].argmin(1)
                    done[at] = rank[at, best[at]] == none
                    at = at[(due[at] == 0) & ~done[at]]
            else:
                done = np.ones(len(live), bool)
            if done.any():
                ended = pieces[done]
                real = ended != PAD
                ends = np.cumsum(2 * real.sum(1))
                raw, bounds = ended[real].astype("<u2").tobytes(), [0, *ends.tolist()]
                ids = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
                for n in np.flatnonzero((real & (ended < 0)).any(1)).tolist():
                    ids[n] = _ids(model, ended[n, real[n]].tolist())
                for i, x, m in zip(live[done].tolist(), ids, merged[done].tolist()):
                    out[i], last[i] = x, m
                left = ~done
                if not left.any():
                    break
                live, pieces, rank, made, best = live[left], pieces[left], rank[left], made[left], best[left]
                skips, merged, due = skips[left], merged[left], due[left]
                rows = np.arange(len(live))
            pieces[rows, best] = made[rows, best]
            merged += 1
            keep = np.ones(pieces.shape, bool)
            keep[rows, best + 1] = False
            pieces = pieces[keep].reshape(-1, width - 1)
            if width == 2:
                continue
            # the pair that merged goes; its neighbours are looked up anew
            gone = np.ones(rank.shape, bool)
            gone[rows, np.minimum(best, width - 2)] = False
            rank, made = rank[gone].reshape(-1, width - 2), made[gone].reshape(-1, width - 2)
            for shift in (-1, 0):
                at = best + shift
                ok = np.flatnonzero((at >= 0) & (at < width - 2))
                col = at[ok]
                rank[ok, col], made[ok, col] = candidates(pieces[ok, col], pieces[ok, col + 1])
    return out, last


def _whole(model: Model, words: list[str]) -> tuple[list[bytes], list[int]]:
    """Ids of each word without skips, and how many candidates merge; from the library, but for texts that it alters or spells by bytes."""
    plain = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and MARK not in w and "\0" not in w]
    found = model.library.encode([words[i][1:] for i in plain], num_threads=1) if plain else []  # it puts a mark in front
    ends = np.cumsum([0] + [len(x) for x in found])
    flat = np.fromiter(itertools.chain.from_iterable(found), "<u2", int(ends[-1]))
    spelt = np.add.reduceat(model.is_byte[flat], ends[:-1]) > 0 if len(flat) else np.zeros(0, bool)
    raw, bounds = flat.tobytes(), (2 * ends).tolist()
    out, merged = [b""] * len(words), [-1] * len(words)
    for i, a, b, bytes_in in zip(plain, bounds, bounds[1:], spelt.tolist()):
        if not bytes_in:
            out[i], merged[i] = raw[a:b], len(words[i]) - (b - a) // 2
    rest = [i for i, m in enumerate(merged) if m < 0 and len(words[i]) <= LONG]
    for i, ids, m in zip(rest, *_segmented(model, [words[i] for i in rest], lambda at, k: np.full(len(at), NEVER))):
        out[i], merged[i] = ids, m
    for i, m in enumerate(merged):
        if m < 0:  # only met without dropout, where the merges do not count
            out[i], merged[i] = _agenda(model, words[i], 0, 0.0), 0
    return out, merged


class Memo:
    """The segmentations met so far: a node is a word with some skips, its children have one more."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.root: dict[str, int] = {}
        self.child: dict[int, int] = {}  # by node and the number of merges before the skip
        self.word: list[str] = []
        self.ids: list[bytes] = []
        # parent; merges between the last skip and the one before; merges after the last skip, fewer than LONG
        self.parent, self.gap, self.merged = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, words: list[str], parent: np.ndarray, gap: np.ndarray, ids: list[bytes], merged: list[int]) -> range:
        first = len(self.word)
        self.word += words
        self.ids += ids
        self.parent, self.gap, self.merged = (np.concatenate(x) for x in ((self.parent, parent), (self.gap, gap), (self.merged, np.array(merged, np.int64))))
        return range(first, len(self.word))

    def roots(self, model: Model, words: list[str]) -> None:
        none = np.full(len(words), -1, np.int64)
        self.root.update(zip(words, self.add(words, none, none, *_whole(model, words))))

    def children(self, model: Model, keys: np.ndarray, depth: int) -> None:
        """Nodes of ``depth`` skips, by their keys."""
        gaps = np.full((len(keys), depth + 1), NEVER)
        parent, node = keys >> 6, keys >> 6
        gaps[:, depth - 1] = keys & 63
        for k in range(depth - 2, -1, -1):
            gaps[:, k], node = self.gap[node], self.parent[node]
        words = list(map(self.word.__getitem__, parent.tolist()))
        self.child.update(zip(keys.tolist(), self.add(words, parent, keys & 63, *_segmented(model, words, lambda i, k: gaps[i, k]))))


_SPLIT = re.compile(r" *[^ ]+| +")


def encode_texts(model: Model, texts: list[str], keys: list, seed: int = SEED, rate: float = RATE, memo: Memo | None = None) -> list[bytes]:
    """Ids of each text as little-endian 16-bit numbers."""
    memo = Memo() if memo is None else memo
    if len(memo.ids) > MEMO:
        memo.clear()
    split = [_SPLIT.findall(" " + text) if text else [] for text in texts]
    words = list(itertools.chain.from_iterable(split))
    sizes = np.array([len(x) for x in split], np.int64)
    new = set(words).difference(memo.root)
    apart = {w for w in new if len(w) > LONG} if rate > 0 else set()
    memo.roots(model, list(new - apart))
    memo.root.update(dict.fromkeys(apart, -1))  # segmented for each occurrence
    at = np.fromiter(map(memo.root.__getitem__, words), np.int64, len(words))
    drawn = occurrences(keys, sizes, seed)
    open_ = np.flatnonzero(at >= 0)
    for k in itertools.count():
        gap = _gaps(drawn[open_], k, rate)
        skips = gap < memo.merged[at[open_]]
        open_, gap = open_[skips], gap[skips]
        if not len(open_):
            break
        pairs, back = np.unique(at[open_] << 6 | gap, return_inverse=True)
        nodes = list(map(memo.child.get, pairs.tolist()))
        if None in nodes:
            memo.children(model, pairs[[x is None for x in nodes]], k + 1)
            nodes = list(map(memo.child.__getitem__, pairs.tolist()))
        at[open_] = np.array(nodes)[back]
    long = np.flatnonzero(at < 0).tolist()
    at[long] = 0
    ids = list(map(memo.ids.__getitem__, at.tolist())) if memo.ids else [b""] * len(words)
    for i in long:
        ids[i] = _agenda(model, words[i], int(drawn[i]), rate)
    ends = np.cumsum(np.r_[0, sizes]).tolist()
    return [b"".join(ids[a:b]) for a, b in zip(ends, ends[1:])]


def occurrences(keys: list, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The key of each word of documents with these ids and numbers of words."""
    starts = [int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little") for key in keys]
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return _keys(np.repeat(np.array(starts, np.uint64), sizes), np.arange(len(first)) - first)


def decode_ids(model: Model, ids: bytes) -> str:
    """The text; the mark that encoding put in front goes."""
    data = b"".join(map(model.output.__getitem__, np.frombuffer(ids, "<u2").tolist()))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: float = RATE,
           digest: bool = False) -> DataFrame:
    """Per document: doc_id and ids (array of ints).

    With ``digest`` instead of ids: n_pieces, ids_crc32 (of the 16-bit little-endian ids) and
    lossless (decoding the ids gives the text again).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = Model(model_path)
        memo = Memo()
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), BLOCK):
                part = batch.slice(at, BLOCK)
                texts = [t or "" for t in part.column(1).to_pylist()]
                keys = [k or 0 for k in part.column(0).to_pylist()]
                made = encode_texts(model, texts, keys, seed, rate, memo)
                if digest:
                    columns = [
                        pa.array([len(x) // 2 for x in made], pa.int64()), pa.array([zlib.crc32(x) for x in made], pa.int64()),
                        pa.array([decode_ids(model, x) == t for x, t in zip(made, texts)], pa.bool_()),
                    ]
                    names = ["n_pieces", "ids_crc32", "lossless"]
                else:
                    flat = np.frombuffer(b"".join(made), "<u2").astype(np.int32)
                    ends = np.cumsum([0] + [len(x) // 2 for x in made]).astype(np.int32)
                    columns, names = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["ids"]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *names])

    out = "n_pieces long, ids_crc32 long, lossless boolean" if digest else "ids array<int>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {out}")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and text; NULL ids give the empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        model = Model(model_path)
        for batch in batches:
            texts = [decode_ids(model, np.array(x or [], "<u2").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
