"""A training corpus from raw documents: clear language, no copies, no near copies, mixed, packed.

Each stage gets what the one before it kept, as Parquet, and works on all of it.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftlines.llm import common, dedup, langid, mixing, packing, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    return langid.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id."""
    return dedup.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest id.

    Near is what op7's contract says: fingerprints that differ in 4 of 64 bits at most.  Most pairs whose 4-word shingles are
    0.95 alike or less differ in more and stay; the README has the shares.
    """
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in training order."""
    return mixing.curriculum(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins: (doc_id, source, cluster, piece, piece_size, packer, bin, bin_offset)."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The stages compress, fingerprint and pack; tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = f"{common.folder(spark)}/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
