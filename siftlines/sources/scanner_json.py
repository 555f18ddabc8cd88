"""Findings from the JSON another scanner printed."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlines import schema
from siftlines.functions.text import strip


def _results(outputs: DataFrame, raw: str) -> DataFrame:
    """One row per result; text around the outermost braces is ignored, and an
    output that is no JSON gives no rows.

    Results count on from ``ord`` where the outputs have that column, so that many
    outputs with few results each (one a line, as a large tree should be printed) keep an order.
    """
    body = F.regexp_extract(F.col(raw), r"(?s)\{.*\}", 0)
    order = F.col("ord").cast("int") if "ord" in outputs.columns else F.lit(0)
    parsed = outputs.select(order.alias("first"), F.from_json(body, schema.SCANNER_OUTPUT).alias("output"))
    return parsed.select("first", F.posexplode("output.results").alias("place", "r")).select(
        (F.col("first") + F.col("place")).alias("rule_ord"), "r")


def findings(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Findings as printed; only the severity has a default."""
    return _results(outputs, raw).select(
        F.col("r.check_id").alias("check_id"), F.col("r.path").alias("file"),
        F.col("r.start.line").alias("line"), F.col("r.extra.message").alias("message"),
        F.upper(F.coalesce("r.extra.severity", F.lit("INFO"))).alias("severity"),
        strip(F.coalesce("r.extra.lines", F.lit(""))).alias("snippet"), "rule_ord")


def normal_path(path: Column) -> Column:
    """A path without empty and ``.`` parts, and with every ``..`` taken back."""
    absolute = path.startswith("/")

    def step(done, part):
        last = F.get(done, F.size(done) - 1)
        return (F.when(part != "..", F.concat(done, F.array(part)))
                .when(last.isNotNull() & (last != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
                .when(absolute, done).otherwise(F.concat(done, F.array(part))))

    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(kept, "/"))


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    """outputs(raw, ord) of files with one result as JSON per line: read in parallel, each line a result of its own."""
    lines = spark.read.text(path)
    return lines.select(F.concat(F.lit('{"results":['), "value", F.lit("]}")).alias("raw"),
                        F.monotonically_increasing_id().alias("ord"))


def bulk_findings(outputs: DataFrame, root: str = "", raw: str = "raw") -> DataFrame:
    """Findings of a whole-tree run: paths resolved against ``root``, every field set."""
    path = F.coalesce("r.path", F.lit(""))
    absolute = F.when(path.startswith("/") | (F.lit(root) == ""), path).otherwise(
        F.concat(F.lit(root.rstrip("/") + "/"), path))
    return _results(outputs, raw).select(
        F.col("r.check_id").alias("check_id"),
        normal_path(absolute).alias("file"),
        F.coalesce("r.start.line", F.lit(0)).alias("line"),
        F.coalesce("r.extra.message", F.lit("")).alias("message"),
        F.upper(F.coalesce("r.extra.severity", F.lit("INFO"))).alias("severity"),
        strip(F.coalesce("r.extra.lines", F.lit(""))).alias("snippet"), "rule_ord")


def to_scanner_json(found: DataFrame) -> DataFrame:
    """Findings as scanner outputs, one result each, with the position they were found at."""
    result = F.struct(
        F.col("check_id"), F.col("file").alias("path"), F.struct(F.col("line")).alias("start"),
        F.struct(F.col("message"), F.col("severity"), F.col("snippet").alias("lines")).alias("extra"))
    order = [F.col("rule_ord").alias("ord")] if "rule_ord" in found.columns else []
    return found.select(F.to_json(F.struct(F.array(result).alias("results"))).alias("raw"), *order)
