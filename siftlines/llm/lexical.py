"""Ranked lexical search over an index of documents in strata of equal length.

A document's score for an item is the sum over the item's terms of weight times impact, and the impact of a term depends on its
occurrences tf in the document and on the document's normaliser m alone.  So documents are grouped by m: a stratum has one impact for
each tf, worked out once, and its largest tf of every term bounds what any of its documents can score.  Each item visits the strata
with the best bounds first, until they hold ``FIRST_DOCS`` documents; its k-th best score there is the least that another
document has to reach, and only the strata whose bound reaches it are visited at all.

Items are taken in blocks of at most ``ITEM_TERMS`` terms (of a single item, if it has more), so what tasks are sent is bounded; postings of
other terms are counted, for the lengths, and not kept.  A stratum is cut into blocks of ``BLOCK_DOCS`` documents, so one length may hold
any share of the documents.  A block returns at most k documents an item.

Null and empty texts and those without terms count for nothing and are never found; texts of any length are read whole.  Repeated rows
are documents of their own; of equal scores smaller ids come first and null ids last, rows with equal ids in any order.  Each row of
the items is an item, also if ids repeat or are null; those without terms find nothing.  Other columns play no part, whatever
their names.  An empty table of documents or items gives an empty result.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftlines.llm import common

K = 50
ITEM_TERMS = 1 << 17
FIRST_DOCS = 1000
BLOCK_DOCS = 2048
#: Different terms whose impacts on a block of documents lie side by side at a time.
WIDE = 2048

#: Bytes that end a term become blanks; only A-Z change their case.
_TERM_BYTES = bytes.maketrans(
    bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80), *range(0x41, 0x5B)]),
    b" " * (0x30 + 7 + 6 + 5) + bytes(range(0x61, 0x7B)))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and anything beyond ASCII; other ASCII ends a term."""
    return (text or b"").translate(_TERM_BYTES).split()


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms(text))) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"])


def _postings(numbers: dict[bytes, int], kind: pa.DataType):
    """(doc_id, n, terms, tfs) of every document with terms, for terms that have numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in common.slices(batch, 1)):
            n, which, tfs, rows = [], [], [], []
            for row, text in enumerate(part.column(1).to_pylist()):
                if words := terms(text):
                    found = Counter(map(numbers.get, words))
                    found.pop(None, None)
                    rows.append(row)
                    n.append(len(words))
                    which.append(list(found))
                    tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows, pa.int64())).cast(kind), pa.array(n, pa.int64()),
                 pa.array(which, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return run


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def best_of(score: np.ndarray, k: int, least: int) -> np.ndarray:
    """Places of the k highest scores from ``least`` on, and of those equal to the last of them."""
    good = np.flatnonzero(score >= least)
    if len(good) > k:
        kth = np.partition(score[good], len(good) - k)[len(good) - k]
        good = good[score[good] >= kth]
    return good


def _visit(starts: np.ndarray, which: np.ndarray, weights: np.ndarray, k: int):
    """Scores of the documents of a block for the items that visit it; an item's terms are ``which[starts[i]:starts[i + 1]]``."""
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        out_item, out_row, out_score = [], [], []
        items, floors = asked["item"].to_numpy(), asked["floor"].to_numpy()
        lists = docs["terms"].combine_chunks()
        row = np.repeat(np.arange(docs.num_rows), np.diff(lists.offsets.to_numpy()) if docs.num_rows else 0)
        term = lists.flatten().to_numpy()
        times, of = np.unique(docs["tfs"].combine_chunks().flatten().to_numpy(), return_inverse=True)
        worth = impact(times, docs["m"][0].as_py() if docs.num_rows else 1)[of]  # once for each tf
        at = 0
        while at < len(items) and docs.num_rows:
            held, to = set(), at
            while to < len(items) and (to == at or len(held) < WIDE):
                held.update(which[starts[items[to]]:starts[items[to] + 1]].tolist())
                to += 1
            column = np.array(sorted(held), np.int64)
            place = np.minimum(np.searchsorted(column, term), max(len(column) - 1, 0))
            own = column[place] == term if len(column) else np.zeros(len(term), bool)
            table = np.zeros((len(column), docs.num_rows), np.int64)
            table[place[own], row[own]] = worth[own]
            highest = table.max(axis=1, initial=0)
            for i in range(at, to):
                span = slice(starts[items[i]], starts[items[i] + 1])
                columns, w = np.searchsorted(column, which[span]), weights[span]
                if w @ highest[columns] >= floors[i]:
                    score = w @ table[columns]
                    good = best_of(score, k, max(1, floors[i]))
                    out_item.append(np.full(len(good), items[i]))
                    out_row.append(good)
                    out_score.append(score[good])
            at = to
        joined = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.table({"item": pa.array(joined(out_item), pa.int32()), "doc_id": docs["doc_id"].take(pa.array(joined(out_row), pa.int64())),
                         "score": pa.array(joined(out_score), pa.int64())})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(docs: DataFrame, asked: list[list[bytes]], k: int, first_docs: int) -> DataFrame:
    """(item, rank, doc_id, score) of the items with these terms, which are numbered in order."""
    spark = docs.sparkSession
    numbers = {term: i for i, term in enumerate(sorted({t for some in asked for t in some}))}
    kind, arrow = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    counted = common.table(docs.mapInArrow(
        _postings(numbers, arrow), f"doc_id {kind}, n long, terms array<int>, tfs array<long>"))
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["term"]: r["n"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("n")).collect()}  # one row for a term of the items
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    lists = [[numbers[t] for t in some if numbers[t] in df] for some in asked]
    starts = np.cumsum([0, *map(len, lists)])
    which = np.array([t for some in lists for t in some], np.int64)
    weights = np.array([weight[t] for t in which.tolist()], np.int64)
    wanted = spark.createDataFrame(
        [(i, t, weight[t]) for i, some in enumerate(lists) for t in some], "item int, term int, weight long")

    m = (50 + F.expr(f"(cast(50 * n as decimal(20, 0)) * {n_docs}L) div {max(n_terms, 1)}L")).cast("long")
    index = counted.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs")
    tops = index.select("m", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).groupBy(
        "m", F.col("p.terms").alias("term")).agg(F.max("p.tfs").alias("tf"))
    bounds = common.table(tops.join(wanted, "term").groupBy("item", "m").agg(F.sum(
        F.col("weight") * F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)")).alias("bound")).where("bound > 0"))
    strata = common.table(index.groupBy("m").agg(F.count("*").alias("docs")).withColumn(
        "blocks", F.ceil(F.col("docs") / BLOCK_DOCS).cast("int")))
    blocked = common.with_group(index, strata, "m", "docs").select(
        "doc_id", "m", "terms", "tfs", F.pmod(F.xxhash64("doc_id", "terms", F.monotonically_increasing_id()), F.col("blocks")).cast("int").alias("block"))
    blocked = common.table(blocked)

    def visited(visits: DataFrame) -> DataFrame:
        split = visits.join(strata.select("m", "blocks"), "m").select(
            "item", "floor", "m", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        seen = blocked.join(visits.select("m").distinct(), "m", "left_semi")
        found = seen.groupBy("m", "block").cogroup(split.groupBy("m", "block")).applyInArrow(
            _visit(starts, which, weights, k), f"item int, doc_id {kind}, score long")
        return common.table(_ranked(found, k))

    before = Window.partitionBy("item").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    order = common.table(bounds.join(strata.select("m", "docs"), "m").withColumn(
        "before", F.coalesce(F.sum("docs").over(before), F.lit(0))))
    early = visited(order.where(F.col("before") < first_docs).select("item", "m", F.lit(1).cast("long").alias("floor")))
    floors = early.where(F.col("rank") == k).select("item", F.col("score").alias("floor"))
    rest = order.where(F.col("before") >= first_docs).join(floors, "item", "left").select(
        "item", "m", "bound", F.coalesce("floor", F.lit(1)).cast("long").alias("floor")).where("bound >= floor")
    late = visited(common.table(rest.drop("bound")))
    return _ranked(early.drop("rank").unionByName(late.drop("rank")), k)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", k: int = K, item_terms: int = ITEM_TERMS, first_docs: int = FIRST_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 of every item."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    named = common.table(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("text")).withColumn(
        "item", F.monotonically_increasing_id()))
    split = common.table(named.select("item", "text").mapInArrow(_items, "item long, terms array<binary>"))
    kept = split.where(F.size("terms") > 0)
    total = kept.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // item_terms))
    found = None
    for block in range(blocks):
        asked = kept.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item").collect()
        if not asked:
            continue
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(asked)], "number int, item long")
        part = _search(slim, [[bytes(t) for t in r["terms"]] for r in asked], k, first_docs).withColumnRenamed("item", "number").join(
            names, "number").select("item", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        none = named.join(slim.select("doc_id"), F.lit(False))
        return none.select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return found.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
