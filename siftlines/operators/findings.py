"""Relational work on findings: distinct, counts, rankings, lookups.

Findings carry ``rule_ord``; (file, rule_ord, line) is the order in which they
were found, and every tie is broken by it.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlines.functions import lookups, text
from siftlines.functions.classify import category, dashboard_severity, display_severity, weakness_id
from siftlines.operators import lines


# Bits of the map of lines that are looked up: 16 MB when full, whatever the number of findings.
MARK_BITS = 1 << 26


def found_order() -> Column:
    return F.struct("file", "rule_ord", "line")


def classified(findings: DataFrame) -> DataFrame:
    """Findings with weakness id, category and display severity."""
    return findings.withColumns({
        "weakness": weakness_id(F.col("message")),
        "category": category(F.col("message")),
        "display_severity": display_severity(F.col("severity")),
    })


def categories_by_join(findings: DataFrame) -> DataFrame:
    """Category by weakness id alone, as a join with the lookup table.

    The lookup is a constant of a few dozen rows, hence the broadcast.
    """
    spark = findings.sparkSession
    table = spark.createDataFrame(list(lookups.WEAKNESS_CATEGORY.items()), "weakness string, category string")
    return (findings.withColumn("weakness", weakness_id(F.col("message")))
            .join(F.broadcast(table), "weakness", "left")
            .withColumn("category", F.coalesce("category", F.lit("Other"))))


def distinct_findings(findings: DataFrame, *order: str) -> DataFrame:
    """One finding per (file, line, message): the first in ``order``.

    An aggregate, not a window: copies are merged before the shuffle, so a
    finding repeated very often does not end up in one task.
    """
    key = ["file", "line", "message"]
    rest = [c for c in findings.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    merged = findings.groupBy(*key).agg(first).select(*key, "first.*")
    return merged.select(*findings.columns)


def new_findings(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates that are not in ``known`` as whole records."""
    shared = [c for c in candidates.columns if c in known.columns]
    same = None
    for name in shared:
        equal = F.col(f"c.{name}").eqNullSafe(F.col(f"k.{name}"))
        same = equal if same is None else same & equal
    return candidates.alias("c").join(known.select(*shared).alias("k"), same, "left_anti")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(display_severity(F.col("severity")).alias("severity")).agg(
        F.count("*").alias("n_findings"))


def severity_totals(findings: DataFrame) -> DataFrame:
    """One row: findings by display severity and in total; unknown ones only count in the total."""
    shown = display_severity(F.col("severity"))
    return findings.agg(
        F.count_if(shown == "HIGH").alias("high"), F.count_if(shown == "MEDIUM").alias("medium"),
        F.count_if(shown == "LOW").alias("low"), F.count("*").alias("total"))


def dashboard_counts(findings: DataFrame) -> DataFrame:
    """One row: findings by display severity (unknown ones are LOW) and in total."""
    shown = dashboard_severity(F.col("severity"))
    return findings.agg(
        F.count_if(shown == "HIGH").alias("high"), F.count_if(shown == "MEDIUM").alias("medium"),
        F.count_if(shown == "LOW").alias("low"), F.count("*").alias("total"))


def category_counts(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Categories by frequency, ties in order of first appearance, with their rank."""
    counted = findings.groupBy(category(F.col("message")).alias("category")).agg(
        F.count("*").alias("n_findings"), F.min(found_order()).alias("first"))
    ranked = counted.orderBy(F.desc("n_findings"), "first")
    if limit is not None:
        ranked = ranked.limit(limit)
    # The number of categories is fixed by the lookup tables, so one partition holds them.
    order = Window.orderBy(F.desc("n_findings"), "first")
    return ranked.select(F.row_number().over(order).alias("rank"), "category", "n_findings")


def rule_files(findings: DataFrame) -> DataFrame:
    """Distinct (rule, file) pairs with the first place of each."""
    return findings.groupBy("check_id", "file").agg(F.min(found_order()).alias("first"))


def cross_file_rules(findings: DataFrame, limit: int = 10) -> DataFrame:
    """Rules found in at least two files, by number of files, with those files.

    The files stay rows: a rule that hits a third of the corpus is never
    gathered into one value.
    """
    pairs = rule_files(findings)
    top = (pairs.groupBy("check_id").agg(F.count("*").alias("n_files"), F.min("first").alias("first"))
           .where("n_files >= 2").orderBy(F.desc("n_files"), "first").limit(limit))
    # At most ``limit`` rows.
    return pairs.select("check_id", "file").join(F.broadcast(top.select("check_id", "n_files")), "check_id")


def top_files(scores: DataFrame, limit: int = 5) -> DataFrame:
    """Files with the highest score, ties by path."""
    return scores.orderBy(F.desc("risk_score"), "file").limit(limit)


def _mark(file: Column, line: Column) -> Column:
    """The bit of a (file, line) in a map of ``MARK_BITS`` bits."""
    return F.pmod(F.xxhash64(file, line.cast("long")), F.lit(MARK_BITS))


def wanted_lines(findings: DataFrame, files: DataFrame) -> DataFrame:
    """lines(file, line, text) that findings point to, and a few more: those whose bit another line has set.

    The bits are at most ``MARK_BITS`` / 64 words, so they are broadcast; a line is tested in the task that cut it
    from its file and goes no further if its bit is not set.
    """
    slot = F.col("slot")
    marks = (findings.select(_mark(F.col("file"), F.col("line")).alias("slot"))
             .groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")))
    cut = lines.reader_lines(files).select(F.col("path").alias("file"), "line", "text", _mark(F.col("path"), F.col("line")).alias("slot"))
    return (cut.join(F.broadcast(marks), F.shiftright(slot, 6) == F.col("word"))
            .where("shiftright(bits, cast(slot & 63 as int)) & 1 = 1").select("file", "line", "text"))


def line_snippets(findings: DataFrame, files: DataFrame) -> DataFrame:
    """The source line of every finding, '' when the file has no such line.

    Lines that no finding points to stay where they are, and of the others only what is shown moves.  ``findings`` is read twice.
    """
    shown = wanted_lines(findings, files).select(
        "file", "line", text.snippet(F.col("text"), lookups.LOOKUP_SNIPPET_CHARS).alias("source_line"))
    return findings.join(shown, ["file", "line"], "left").withColumn(
        "source_line", F.coalesce("source_line", F.lit("")))


def files_with_findings(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Every file with its findings; a file without any gives one row of nulls."""
    return files.select(F.col("path").alias("file"), "language").join(findings, "file", "left")
