"""Rules over several statements of one C function."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlines.functions import catalog, lookups, text
from siftlines.operators import blocks

_FREED = r"\bfree[ \t]*\([ \t]*(\w+)[ \t]*\)"
_USED = r"(\w+)[ \t]*->"
_ALLOCATED = r"(\w+)[ \t]*=[ \t]*(?:\([^()]*\)[ \t]*)?malloc[ \t]*\("
_CHECKED = (r"(\w+)[ \t]*[!=]=[ \t]*(?:NULL|0)\b", r"\b(?:NULL|0)[ \t]*[!=]=[ \t]*(\w+)",
            r"![ \t]*(\w+)", r"\bif[ \t]*\([ \t]*(\w+)[ \t]*[)&|]")


def pointer_events(files: DataFrame) -> DataFrame:
    """events(path, block, line, kind, pointer, raw) inside C functions.

    Only lines that touch a pointer leave their file.
    """
    lined = blocks.lined(files.where("language = 'c'"), mask_c=True)

    def touching(function):
        lines = F.slice("pairs", function["first"], function["last"] - function["first"] + 1)
        numbered = F.transform(lines, lambda p, i: F.struct(
            (function["first"] + i).alias("line"), function["first"].alias("block"),
            p["code"].alias("code"), p["raw"].alias("raw")))
        return F.filter(numbered, lambda x: x["code"].rlike(r"free|->|malloc|[!=]=|!|\bif\b"))

    located = lined.select("path", F.inline(F.flatten(
        F.transform(blocks.c_functions(F.col("pairs")), touching))))

    def events(kind: str, *patterns: str) -> Column:
        names = F.concat(*[F.regexp_extract_all("code", F.lit(p), 1) for p in patterns])
        return F.transform(F.array_distinct(names), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("pointer")))

    every = F.concat(events("free", _FREED), events("use", _USED), events("malloc", _ALLOCATED),
                     events("check", *_CHECKED))
    return located.select("path", "block", "line", "raw", F.inline(every))


def _as_findings(rows: DataFrame, rule_id: Column) -> DataFrame:
    def of(index: int) -> Column:
        pairs = [F.lit(x) for name, row in catalog.sequence_rules().items() for x in (name, row[index])]
        return F.element_at(F.create_map(*pairs), F.col("check_id"))

    order = F.create_map(*[F.lit(x) for i, name in enumerate(catalog.sequence_rules()) for x in (name, 1000 + i)])
    return (rows.withColumn("check_id", rule_id)
            .groupBy("check_id", F.col("path").alias("file"), "line").agg(F.min("raw").alias("raw"))
            .select("check_id", "file", "line", of(1).alias("message"), of(0).alias("severity"),
                    text.snippet(F.col("raw"), lookups.SCAN_SNIPPET_CHARS).alias("snippet"),
                    F.element_at(order, F.col("check_id")).alias("rule_ord")))


def sequence_findings(files: DataFrame) -> DataFrame:
    """Lines that

    - free a pointer which a later line of the function frees again,
    - free a pointer which a later line of the function follows, or
    - allocate a pointer whose next use no check comes before.

    A window is one pointer of one function, read from the last line up, so
    that what lies ahead of a line has been seen when it is reached.
    """
    ahead = (Window.partitionBy("path", "block", "pointer").orderBy(F.desc("line"))
             .rangeBetween(Window.unboundedPreceding, -1))
    seen = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("line"))).over(ahead)
    marked = pointer_events(files).withColumns({
        "next_free": seen("free"), "next_use": seen("use"), "next_check": seen("check")})
    freed, allocated = F.col("kind") == "free", F.col("kind") == "malloc"
    unchecked = F.col("next_use").isNotNull() & (
        F.col("next_check").isNull() | (F.col("next_check") > F.col("next_use")))
    rules = F.array_compact(F.array(
        F.when(freed & F.col("next_free").isNotNull(), "c-double-free"),
        F.when(freed & F.col("next_use").isNotNull(), "c-use-after-free"),
        F.when(allocated & unchecked, "c-null-deref-no-check")))
    return _as_findings(marked.select("path", "line", "raw", F.explode(rules).alias("rule")), F.col("rule"))
