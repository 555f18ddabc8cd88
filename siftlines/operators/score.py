"""The two risk scores, per file or per any other key."""

from pyspark.sql import Column, DataFrame, functions as F

from siftlines.functions import text
from siftlines.functions.classify import display_severity, scored_severity


def severity_score(errors: Column, warnings: Column, infos: Column) -> Column:
    """Score of the worst severity present plus a step for every other finding.

    Worst: ERROR 7, WARNING 4, INFO 1; steps 1, 0.5 and 0.1; at most 10.
    Worked out in tenths, so that the result is the exact decimal.
    """
    steps = errors * 10 + warnings * 5 + infos
    tenths = (F.when(errors > 0, 70 - 10 + steps).when(warnings > 0, 40 - 5 + steps)
              .when(infos > 0, 10 - 1 + steps).otherwise(0))
    return F.least(tenths, F.lit(100)) / 10.0


def severity_scores(findings: DataFrame, *keys: str) -> DataFrame:
    """Severity-first score and finding counts per key."""
    severity = scored_severity(F.col("severity"))
    counted = findings.groupBy(*keys).agg(
        F.count("*").alias("n_findings"),
        F.count_if(severity == "ERROR").alias("errors"),
        F.count_if(severity == "WARNING").alias("warnings"),
        F.count_if(severity == "INFO").alias("infos"))
    return counted.select(
        *keys, "n_findings", "errors", "warnings", "infos",
        severity_score(F.col("errors"), F.col("warnings"), F.col("infos")).alias("risk_score"))


def density_weight(severity: Column) -> Column:
    shown = display_severity(severity)
    return F.when(shown == "HIGH", 3.0).when(shown == "MEDIUM", 2.0).otherwise(0.5)


def density_score(weight: Column, line_count: Column) -> Column:
    """Severity weight per logarithm of the file length, at most 10."""
    density = weight / F.log(F.greatest(line_count, F.lit(2))) * 5.0
    return F.bround(F.least(F.lit(10.0), density), 1)


def with_density(sized: DataFrame, findings: DataFrame) -> DataFrame:
    """Files(file, reader_lines, ...) with their number of findings and density score."""
    weights = findings.groupBy("file").agg(
        F.count("*").alias("n_findings"), F.sum(density_weight(F.col("severity"))).alias("weight"))
    return sized.join(weights, "file", "left").withColumns({
        "n_findings": F.coalesce("n_findings", F.lit(0)),
        "risk_score": F.when(F.col("weight").isNull(), 0.0).otherwise(
            density_score(F.col("weight"), F.col("reader_lines")))}).drop("weight")


def density_scores(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Density score of every file, 0 for a file without findings.

    Contents are reduced to a line count before anything moves.
    """
    sized = files.select(F.col("path").alias("file"), text.reader_line_count(F.col("content")).alias("reader_lines"))
    return with_density(sized, findings)
