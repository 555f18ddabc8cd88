"""What several operators share: durable tables, folds, running sums in a global order, joins with hot keys."""

import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlines import session

#: A maximal run of anything but these six bytes is a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a task turns into arrays at a time.
SLICE_BYTES = 4 << 20


def table(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor costs a re-read, and a value that depends
    on the run (a row number) stays what it was.  ``clear`` removes the files.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    return f"{session.checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove the tables of this application; its results have to be written by then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with one row per ``key`` of ``groups``, whatever a key's share of the rows.

    ``size`` is the number of rows of a key.  Keys above a fair share of a
    quarter partition are at most four times as many as there are partitions,
    so they can be broadcast; the others fit a shuffle.
    """
    spark = rows.sparkSession
    fair = 4 * partitions(spark)
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(groups.where(F.col(size) > total / fair))
    cold = groups.where(F.col(size) <= total / fair)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def ordered(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` as a table with ``place``: rising in the order given, consecutive within ``part``."""
    n = partitions(df.sparkSession)
    placed = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("place", F.monotonically_increasing_id()))
    return table(placed).withColumn("part", F.shiftright("place", 33).cast("int"))


def running(df: DataFrame, order: list, sums: dict[str, Column], by: str | None = None) -> DataFrame:
    """Adds to each row, for every entry of ``sums``, the sum over all rows before it in ``order``.

    With ``by``, which has to lead the order, sums start anew for each of its
    values.  The order is a range shuffle; each range is summed by itself, and the totals of
    the ranges (one row per range and value of ``by`` in it) give where it starts.
    """
    keys = [by] if by else []
    rows = ordered(df.select("*", *[column.alias(f"_{name}") for name, column in sums.items()]), *order)
    totals = rows.groupBy("part", *keys).agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in sums])
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = table(totals.select("part", *keys, *[
        F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_start_{name}") for name in sums]))
    within = Window.partitionBy("part", *keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.select("*", *[
        F.coalesce(F.sum(f"_{name}").over(within), F.lit(0)).alias(f"_within_{name}") for name in sums])
    same = [F.col("r.part") == F.col("s.part")] + [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    joined = summed.alias("r").join(starts.alias("s"), same)
    return joined.select("r.*", *[(F.col(f"_start_{name}") + F.col(f"_within_{name}")).alias(name) for name in sums]
                         ).drop("place", "part", *[f"{p}_{name}" for name in sums for p in ("", "_within")])


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, in order, with about ``most`` bytes of text each; a longer text is a part by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts in a row, A-Z made small, an end after each text: the different words, the code of each token (0:
    an end; else one more than the word's place) and each text's number of tokens."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, owner = split.flatten(), pc.list_parent_indices(split)
    real = pc.not_equal(flat, "")
    coded = pc.dictionary_encode(flat.filter(real))
    owner = owner.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.bincount(owner, minlength=len(texts)) + 1
    code = np.zeros(int(lengths.sum()), np.int64)
    inside = np.ones(len(code), bool)
    inside[np.cumsum(lengths) - 1] = False
    code[inside] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return coded.dictionary.cast(pa.binary()), code, lengths


def tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """As ``coded``, with the different words as a list."""
    words, code, lengths = coded(texts)
    _, starts, data = words.buffers()  # sliced by hand: to_pylist makes an object more for each word
    cuts = np.frombuffer(starts, np.int32)[words.offset:words.offset + len(words) + 1].tolist() if len(words) else []
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in pairwise(cuts)], code, lengths


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ... so that no name clashes with one that an operator adds."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def plain_name(docs: DataFrame, column: str) -> str:
    return f"c{docs.columns.index(column)}"


def join_id(doc_id: Column) -> Column:
    """An id that joins to itself when null; goes with a hash of the whole row, which tells null from empty."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with plain names and ``_id`` and ``_content``, by which decisions about rows are joined back."""
    renamed = plain(docs)
    return renamed.select("*", join_id(F.col(plain_name(docs, id_col))).alias("_id"),
                          F.xxhash64(*renamed.columns).alias("_content"))
