"""Registered queries of the corpus operators, over whole tables, and their SQL twins."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import hardneg, idfiles, licenses, linedup, neardup, onebit, packing, periodic, phrases, rules, sentpiece, sitequality, toxicity
from panelwright.llm.common import ship

ship(__name__)

#: Folder-independent names of the tokenizer files.
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op2_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"), words=3, percent=85)


def op3_merge_dropout(spark: SparkSession, folder: str) -> DataFrame:
    return sentpiece.encode(_table(spark, folder, "documents"), tokenizer_path(PIECES), digest=True)


def op4_nb_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality_rules(_table(spark, folder, "documents"))


def op6_license_digests(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def op7_id_files(spark: SparkSession, folder: str) -> DataFrame:
    return idfiles.round_trip(_table(spark, folder, "documents"), tokenizer_path(BYTES))


def op8_one_bit_codes(spark: SparkSession, folder: str) -> DataFrame:
    return onebit.search(_table(spark, folder, "embeddings"))


def op9_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    return linedup.deletions(_table(spark, folder, "documents"))


def op10_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    return sitequality.score_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_threshold_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.expr("IF(vec_id % 7 = 0, (CAST(label AS BIGINT) + 1) % 10, CAST(label AS BIGINT))")
    return hardneg.mine(_table(spark, folder, "embeddings"), label=label)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every document whose id's checksum ends in 0, with a periodic tail."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.report(periodic.collapse(_table(spark, folder, "documents"), edit=repeated_tail, digest=True))


def op13_positional_index(spark: SparkSession, folder: str) -> DataFrame:
    shards = phrases.index(_table(spark, folder, "documents"))
    return phrases.report(phrases.search(shards, phrases.windows_of(_table(spark, folder, "benchmark"))))


QUERIES = {f.__name__: f for f in (
    op1_length_buckets, op2_lsh_forest, op3_merge_dropout, op4_nb_ngrams, op5_divergence, op6_license_digests, op7_id_files, op8_one_bit_codes,
    op9_line_runs, op10_site_quality, op11_threshold_negatives, op12_periodic_runs,
    op13_positional_index,
)}


ORACLE = {
    "op2_lsh_forest": neardup.SQL,
    "op6_license_digests": licenses.sql(),
    "op9_line_runs": linedup.SQL,
    "op11_threshold_negatives": hardneg.SQL,
    "op13_positional_index": phrases.SQL,
}
