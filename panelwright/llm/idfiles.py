"""Token-id files: one shared zstandard dictionary, one frame per document, offsets for access.

Layout under the folder given: ``dictionary`` (one row: the dictionary, its SHA-256, the end id)
and ``shards``.  A shard is a row: the frames of up to ``shard_docs`` documents after each other
in ``blob``, ``offsets`` (n + 1 byte positions), ``doc_ids``, ``n_tokens``, the dictionary's
hash, and where it stands (``part``, ``part_start``: ids of the part before the shard).  A frame
is the document's ids as little-endian unsigned 32-bit numbers, compressed with the dictionary
on its own; a reader checks the hash and decompresses only the frames it needs.  Shards are
Parquet rows, so any store that Spark writes will do.

The dictionary is trained on the id arrays of at most ``train_docs`` documents (smallest hashes
of their ids) and ``TRAIN_BYTES`` bytes; every document is encoded and written.

Words of a text are encoded once per Python worker and memoised in two tables of bounded size, which outlive a
task: a byte-level BPE never merges across the start of a word with one blank or line feed before it.  A full table
becomes the old one, from which words still in use move on.  New words of letters, digits and ASCII marks are cut here
by the tokenizer's own pattern, and each piece is merged by the tokenizer's model, so a word and the same word with a
mark behind it are merged once.  Other words go through the tokenizer.  Texts with a blank next to other white space,
with three white spaces in a row or two at the end, or with the text of a special token, go through the tokenizer whole.

Defined cases: NULL text counts as empty (only the end id); NULL ids sort first; repeated ids
stand next to each other, ordered by their frames; an empty table gives an empty file set; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.common import ship
from panelwright.session import shared_folder, stage

ship(__name__)

END_ID = 2
SHARD_DOCS = 1024
SHARD_BYTES = 4 << 20
TRAIN_DOCS = 2_000
TRAIN_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
MEMO = 300_000
BLANK = "Ġ"  # the byte-level form of the blank
#: The byte-level form of each byte, as a table for ``str.translate``.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}
#: White space that is not cut before a single blank or line feed as the tokenizer would cut it.
_ODD = re.compile(r" \s|\s |\s\s\s|\s\s\Z")
_INNER = re.compile(r"[^\S\n]")
#: Characters whose kind does not depend on the version of Unicode: letters, and marks of ASCII.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ʯΑ-ΡΣ-ωЀ-ҁҊ-ԧぁ-ゖァ-ヺ一-龥가-힣"
_MARKS = r"!-/:-@\[-`{-~"
_ASCII_MARKS = string.punctuation
_WORD = re.compile(rf"[{_LETTERS}]+")
_PLAIN = re.compile(rf"\n?[{_LETTERS}0-9{_MARKS}]+|\n")
#: The tokenizer's own pattern on such words.
_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n")


class _Pieces(dict):
    """Ids of the pieces that the tokenizer's pattern cuts a text into, each made once."""

    def __init__(self, model):
        super().__init__()
        self.tokens = model.tokenize

    def ids(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1")
        return array("I", [t.id for t in self.tokens(piece.translate(_BYTES))]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.ids(piece)
        return ids


class _Words(dict):
    """Ids of a word with one blank before it, or that starts with its line feed, each made once.

    ``old`` is the table before: what is still asked for moves on, so words in use outlive the table's size.
    """

    def __init__(self, pieces: _Pieces | None, encode, old: dict):
        super().__init__()
        self.pieces, self.encode, self.old = pieces, encode, old

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._made(word)
        self[word] = ids
        return ids

    def _made(self, word: str) -> bytes:
        if self.pieces is not None:
            if word.isascii() and word.isalpha():
                return array("I", [t.id for t in self.pieces.tokens(BLANK + word)]).tobytes()
            head = word.rstrip(_ASCII_MARKS)
            if _WORD.fullmatch(head):
                if len(head) == len(word):
                    return self.pieces.ids(" " + word)
                return self[head] + self.pieces[word[len(head) :]]
            if _PLAIN.fullmatch(word):
                return b"".join(map(self.pieces.__getitem__, _PIECE.findall(word if word[0] == "\n" else " " + word)))
        if _INNER.search(word):
            raise _Odd
        return self.encode(word if word[:1] == "\n" else " " + word)


class _Odd(Exception):
    """A word holds white space of another kind."""


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, without the end id."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cutter, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        known = isinstance(cutter, pre_tokenizers.ByteLevel) and cutter.use_regex and not cutter.add_prefix_space
        known = known and isinstance(model, models.BPE) and self.tokenizer.normalizer is None
        self.pieces = _Pieces(model) if known else None  # without them, words go through the tokenizer
        self.words = _Words(self.pieces, self._whole, {})

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _head(self, word: str) -> bytes:
        """Ids of a word that opens a text."""
        if self.pieces is not None and _PLAIN.fullmatch(word):
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(word)))
        if _INNER.search(word):
            raise _Odd
        return self._whole(word)

    def _one(self, text: str) -> bytes:
        if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text.endswith("\n\n") or any([s in text for s in self.special]):
            return self._whole(text)
        words = text.replace("\n", " \n").split(" ")
        try:
            return self._head(words[0]) + b"".join(map(self.words.__getitem__, words[1:]))
        except _Odd:
            if _ODD.search(text):
                return self._whole(text)
        words = [words[0], *[w if w[:1] == "\n" else " " + w for w in words[1:]]]
        return b"".join(map(self._whole, words))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.words) + len(self.pieces or ()) > MEMO:
            self.words.old = {}
            self.words = _Words(self.pieces, self._whole, self.words)
            if self.pieces:
                self.pieces.clear()
        return [self._one(text) for text in texts]


def encoder(path: str) -> Encoder:
    """The process's encoder of a tokenizer: its words serve all tasks that a Python worker runs."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _blocks(batches, size: int = 1024):
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), size):
            yield batch.slice(at, size)


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def _encoded(docs: DataFrame, tokenizer_path: str, end_id: int, dictionary: bytes | None) -> DataFrame:
    """doc_id, n_tokens and the frame (without a dictionary given: the plain ids)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import zstandard

        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        known = _dictionary(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known) if known else zstandard.ZstdCompressor(level=LEVEL)
        for part in _blocks(batches):
            made = [x + end for x in encode([t or "" for t in part.column(1).to_pylist()])]
            frames = made if dictionary is None else [packer.compress(x) for x in made]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in made], pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "n_tokens", "frame"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, frame binary")


def train(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, train_docs: int = TRAIN_DOCS) -> bytes:
    """The dictionary from a bounded sample; too little text gives the sample itself, none gives no bytes."""
    import zstandard

    picked = docs.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(train_docs)
    sample = docs.join(F.broadcast(picked.distinct()), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(train_docs)
    arrays, total = [], 0
    for row in _encoded(sample, tokenizer_path, end_id, None).select("frame").toLocalIterator():
        arrays.append(bytes(row.frame))
        total += len(arrays[-1])
        if total > TRAIN_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(arrays)[:DICTIONARY_BYTES]


def write(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
          shard_docs: int = SHARD_DOCS, train_docs: int = TRAIN_DOCS) -> None:
    """Encode all documents and write them in ascending id order."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    dictionary = train(docs, tokenizer_path, end_id, train_docs)
    mark = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(bytearray(dictionary), mark, end_id)], "dictionary binary, dictionary_hash string, end_id long").coalesce(1).write.parquet(f"{folder}/dictionary")
    frames = stage(_encoded(docs, tokenizer_path, end_id, dictionary))
    # the ranges are placed by ids alone; frames follow in order of id and, for repeated ids, of content
    rows = frames.withColumn("tie", F.xxhash64("frame")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "frame")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "frame")

    def run(batches):
        ids, sizes, held, start, number, part = [], [], [], 0, 0, 0

        def shard():
            blob = b"".join(held)
            offsets = np.cumsum([0] + [len(x) for x in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in (
                    (part, pa.int64()), (number, pa.int64()), (start, pa.int64()), (sum(sizes), pa.int64()), (mark, pa.string()),
                    (list(sizes), pa.list_(pa.int64())), (offsets.tolist(), pa.list_(pa.int64())), (blob, pa.binary()),
                )] + [pa.array([list(ids)], pa.list_(id_type))],
                names=["part", "shard", "part_start", "total", "dictionary_hash", "n_tokens", "offsets", "blob", "doc_ids"],
            )

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for p, i, n, frame in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and (len(held) >= shard_docs or sum_bytes + len(frame) > SHARD_BYTES):
                    yield shard()
                    start, number = start + sum(sizes), number + 1
                    ids, sizes, held = [], [], []
                if not held:
                    sum_bytes = 0
                part = p
                ids.append(i)
                sizes.append(n)
                held.append(frame)
                sum_bytes += len(frame)
        if held:
            yield shard()

    schema = f"part long, shard long, part_start long, total long, dictionary_hash string, n_tokens array<long>, offsets array<long>, blob binary, doc_ids array<{kind}>"
    rows.mapInArrow(run, schema).write.parquet(f"{folder}/shards")


def _opened(spark: SparkSession, folder: str) -> tuple[DataFrame, bytes, str]:
    head = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(head.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != head.dictionary_hash:
        raise ValueError("the dictionary does not match its hash")
    return spark.read.parquet(f"{folder}/shards"), dictionary, head.dictionary_hash


def read(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), ids; with ``digest`` n_tokens and ids_crc32 instead of ids."""
    shards, dictionary, mark = _opened(spark, folder)
    # one row per written partition, whose number the session's settings bound
    parts = shards.groupBy("part").agg(F.sum("total").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("__part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    rows = shards.join(parts, F.col("part") == F.col("__part")).select(
        "doc_ids", "n_tokens", "offsets", "blob", "dictionary_hash", (F.col("offset") + F.col("part_start")).alias("start"),
    )
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        import zstandard

        known = _dictionary(dictionary)
        opener = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                sizes, offsets, blob, found, start = (one.column(k)[0].as_py() for k in range(1, 6))
                if found != mark:
                    raise ValueError("a shard was written with another dictionary")
                made = [opener.decompress(blob[a:b], max_output_size=4 * n) for a, b, n in zip(offsets, offsets[1:], sizes)]
                starts = start + np.cumsum([0] + sizes)[:-1]
                columns = [one.column(0).flatten(), pa.array(starts, pa.int64())]
                if digest:
                    columns += [pa.array([len(x) // 4 for x in made], pa.int64()), pa.array([zlib.crc32(x) for x in made], pa.int64())]
                else:
                    flat = np.frombuffer(b"".join(made), "<u4").astype(np.int64)
                    ends = np.cumsum([0] + [len(x) // 4 for x in made]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start"] + (["n_tokens", "ids_crc32"] if digest else ["ids"]))

    return rows.mapInArrow(run, f"doc_id {kind}, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids array<long>"))


def read_documents(spark: SparkSession, folder: str, wanted: list) -> dict:
    """Ids of a few documents: only the shards that hold them are read, only their frames unpacked."""
    import zstandard

    shards, dictionary, _ = _opened(spark, folder)
    known = _dictionary(dictionary)
    opener = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    one = F.explode(F.arrays_zip("doc_ids", "n_tokens", F.slice("offsets", 1, F.size("doc_ids")).alias("a"), F.slice("offsets", 2, F.size("doc_ids")).alias("b"))).alias("x")
    rows = shards.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(w) for w in wanted]))).select("blob", one).filter(F.col("x.doc_ids").isin(wanted))
    rows = rows.select("x.doc_ids", "x.n_tokens", F.expr("substring(blob, x.a + 1, x.b - x.a)").alias("frame"))
    return {r.doc_ids: np.frombuffer(opener.decompress(bytes(r.frame), max_output_size=4 * r.n_tokens), "<u4").tolist() for r in rows.collect()}


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write to a new folder in the shared one and read back: doc_id, start, n_tokens, ids_crc32."""
    import uuid

    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer_path, id_col, text_col)
    return read(spark, folder, digest=True)
