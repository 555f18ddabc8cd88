"""Exact dedup by two passes over a Bloom filter.

The first pass sets bits of every text's hash and keeps the bits that were set
twice; the second tests each row against them.  A row whose bits are not all there cannot
have a copy and passes straight through; only the others are shuffled.

Null counts as empty; empty texts are copies of each other; a null id comes
after all others; of rows equal in text and id one stays.  An empty table gives an
empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlines.llm import common

#: Bits of the filter: at most 2 ** 20 words of 64 bits are broadcast, whatever the input.
FILTER_BITS = 2 ** 26


def normal_text(text: Column) -> Column:
    return F.regexp_replace(common.text_of(text), common.SPACE, " ")


def text_sha256(text: Column) -> Column:
    return F.sha2(normal_text(text).cast("binary"), 256)


def slots(sha: Column, bits: int) -> list[Column]:
    """The two bits that a text sets."""
    return [F.pmod(F.xxhash64(sha, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def repeated_bits(hashes: DataFrame, sha: str, bits: int = FILTER_BITS) -> DataFrame:
    """First pass: (word, bits), the bits that at least two rows have set."""
    twice = (hashes.select(F.explode(F.array(*slots(F.col(sha), bits))).alias("slot"))
             .groupBy("slot").agg(F.count("*").alias("n")).where("n > 1"))
    return common.table(twice.groupBy(F.shiftright("slot", 6).alias("word"))
                        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")))


def split(rows: DataFrame, sha: str, repeated: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Second pass: rows that may have a copy, rows that have none."""
    tested, flags = rows, []
    for i, slot in enumerate(slots(F.col(sha), bits)):
        words = F.broadcast(repeated.select(F.col("word").alias(f"_word{i}"), F.col("bits").alias(f"_bits{i}")))
        tested = (tested.withColumn(f"_slot{i}", slot)
                  .join(words, F.shiftright(f"_slot{i}", 6) == F.col(f"_word{i}"), "left"))
        flags.append(F.expr(f"coalesce(shiftright(_bits{i}, cast(_slot{i} & 63 as int)) & 1, 0) = 1"))
    maybe = flags[0] & flags[1]
    return tested.where(maybe).select(*rows.columns), tested.where(~maybe).select(*rows.columns)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document."""
    hashes = common.table(docs.select(F.col(id_col).alias("doc_id"), text_sha256(F.col(text_col)).alias("text_sha256"))
                          .withColumn("row", F.monotonically_increasing_id()))
    maybe, alone = split(hashes, "text_sha256", repeated_bits(hashes, "text_sha256"))
    groups = common.table(maybe.groupBy("text_sha256").agg(
        F.count("*").alias("group_size"), F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("first")))
    shuffled = common.with_group(maybe, groups, "text_sha256", "group_size").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
    return shuffled.unionByName(alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Copies meet in a partial aggregate: a task sends one row per text, however many it has read.
    """
    rows = common.plain(docs)
    doc_id, text = common.plain_name(docs, id_col), common.plain_name(docs, text_col)
    hashes = common.table(rows.select(text_sha256(F.col(text)).alias("sha")))
    maybe, alone = split(rows.withColumn("sha", text_sha256(F.col(text))), "sha", repeated_bits(hashes, "sha"))
    rank = F.struct(F.isnull(doc_id), F.col(doc_id), F.xxhash64(*rows.columns))
    first = maybe.groupBy("sha").agg(F.min_by(F.struct(*rows.columns), rank).alias("row")).select("row.*")
    return alone.drop("sha").unionByName(first).toDF(*docs.columns)
