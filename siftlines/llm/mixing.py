"""Mixing sources to target weights along a curriculum that changes over training time.

A source's share of all words is set by its weight, but it never gives more than ``LIMIT`` times what it
has; the excess goes to the others by weight.  Its documents stand in a fixed shuffled order, repeated as often as
needed; what lies before the target is taken.  Its weight moves linearly over training time
t in [0, 1]; integrating that schedule gives how many of its words have been asked for by t, and inverting this gives
the t at which a document is due.  Documents are range-sorted by it.

Null text has size 0 and is taken 0 words; a null source is a source, last in order; rows
repeated count as separate documents; an empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlines.llm import common

WEIGHTS = (1, 2, 3)
LIMIT = 3
#: Slope of the schedule 1 + s (1 - 2 t), by position of the source: early, level, late.
SLOPES = (0.5, 0.0, -0.5)


def targets(sources: DataFrame) -> DataFrame:
    """(source, n_docs, source_size, weight, slope, target) from (source, n_docs, source_size).

    The reshared targets are min(level * weight, LIMIT * size) for the one level at which they add up to all words.
    In the order of size by weight, a prefix of the sources is at its limit; the level
    follows from sums over that prefix.
    """
    named = sources.withColumn("absent", F.isnull("source"))
    placed = common.running(named, ["absent", "source"], {"position": F.lit(1).cast("long")})
    cycle = lambda values: F.element_at(
        F.array(*map(F.lit, values)), (F.col("position") % len(values) + 1).cast("int"))
    weighed = common.table(placed.select(
        "source", "n_docs", "source_size", cycle(WEIGHTS).cast("long").alias("weight"), cycle(SLOPES).alias("slope"),
        "position"))
    totals = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    words, weights = totals["words"] or 0, totals["weights"] or 1
    filled = common.running(
        weighed.withColumn("ratio", F.col("source_size") / F.col("weight")), ["ratio", "position"],
        {"full": F.col("source_size") * LIMIT, "spent": F.col("weight")})
    level = (F.lit(words) - F.col("full")) / (F.lit(weights) - F.col("spent"))
    first = filled.select(level.alias("level"), "ratio", "position").where(F.col("level") <= LIMIT * F.col("ratio"))
    found = first.agg(F.min_by("level", F.struct("ratio", "position"))).first()[0]
    level = 0.0 if found is None else float(found)
    return weighed.withColumn("target", F.least(F.lit(level) * F.col("weight"),
                                                (F.col("source_size") * LIMIT).cast("double"))).drop("position")


def due(share: Column, slope: Column) -> Column:
    """The time t at which a source has given ``share`` of its target: (1 + s) t - s t^2 = share."""
    under = F.greatest(F.lit(0.0), (1 + slope) * (1 + slope) - 4 * slope * share)
    return 2 * share / (1 + slope + F.sqrt(under))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document, range-sorted by the time it is first due; those never due come last.

    The columns are those of ``placed``.
    """
    order = [F.col("first_position").asc_nulls_last(), F.col("content"), F.col("doc_id")]
    return (placed(docs, id_col, text_col, source_col)
            .repartitionByRange(common.partitions(docs.sparkSession), *order).sortWithinPartitions(*order))


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, first_position, last_position.

    ``taken`` is the overlap of the document's places in the repeated stream of its source with the target, so a source
    gives its target to within a word; ``copies`` counts the places that begin before the target, and ``positions``
    has the time t of each (null where not taken).  ``content`` is a hash of the whole row.
    """
    rows = common.table(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        common.words(F.col(text_col)).alias("size"), F.xxhash64(*docs.columns).alias("content")))
    sources = common.table(rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")))
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("name")
    known = common.table(targets(sources).select(named, "n_docs", "source_size", "target", "slope"))
    joined = common.with_group(rows.select("*", named), known, "name", "n_docs")
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    stream = common.running(
        joined.withColumn("mixed", shuffled), ["name", "mixed", "content"], {"begin": F.col("size")}, by="name")
    whole = F.round("target").cast("long")
    begins = [F.col("begin") + F.lit(k) * F.col("source_size") for k in range(LIMIT)]
    taken = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), whole - begin)) for begin in begins]
    starts = [F.when(part > 0, begin) for begin, part in zip(begins, taken)]
    at = lambda begin: F.when(begin.isNotNull(), due(
        F.least(F.lit(1.0), begin / F.greatest(F.col("target"), F.lit(1.0))), F.col("slope")))
    copies = sum((part > 0).cast("int") for part in taken)
    last = F.when(copies > 0, F.col("begin") + (copies - 1) * F.col("source_size"))
    return stream.select(
        "doc_id", "source", "size", "source_size", "target", sum(taken[1:], taken[0]).alias("taken"),
        copies.alias("copies"), at(starts[0]).alias("first_position"),
        at(last).alias("last_position"), F.array(*map(at, starts)).alias("positions"), "content")


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, range-sorted by training position.

    Documents without words are never due and leave; the one document at a source's cut is kept whole.
    Rows alike in every column are interchangeable: one of them stands for all and appears as often as all are taken.
    """
    mixed = placed(docs, id_col, text_col, source_col).where("copies > 0")
    times = (mixed.select(common.join_id(F.col("doc_id")).alias("_id"), F.col("content").alias("_content"),
                          F.explode("positions").alias("position")).where("position is not null")
             .groupBy("_id", "_content").agg(F.collect_list("position").alias("_positions")))
    due_rows = common.keyed(docs, id_col).dropDuplicates(["_id", "_content"]).join(times, ["_id", "_content"])
    repeated = due_rows.withColumn("_position", F.explode("_positions"))
    order = ["_position", "_content"]
    return (repeated.repartitionByRange(common.partitions(docs.sparkSession), *order)
            .sortWithinPartitions(*order).drop("_id", "_content", "_positions", "_position").toDF(*docs.columns))
