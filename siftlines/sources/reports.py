"""Result sets and resource reports as JSON files, and report sinks."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlines import schema


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """File results from JSON arrays; fields a writer left out are null."""
    return spark.read.schema(schema.FILE_RESULT).option("multiLine", True).json(path)


def parse_results(rows: DataFrame, column: str = "raw") -> DataFrame:
    """File results from JSON strings, one each."""
    return rows.select(F.from_json(F.col(column), schema.FILE_RESULT).alias("r")).select("r.*")


def parse_reports(rows: DataFrame, column: str = "raw") -> DataFrame:
    """Resource reports from JSON strings; one without a wall time is no report."""
    parsed = rows.select(F.from_json(F.col(column), schema.REPORT).alias("r")).select("r.*")
    return parsed.where("wall_time_s is not null")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.schema(schema.REPORT).option("multiLine", True).json(path)
    return read.where("wall_time_s is not null")


def write_text(lines: DataFrame, path: str) -> None:
    """Report lines, already in order; part files in name order hold the text."""
    lines.select("text").write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def feature_json(features: DataFrame) -> DataFrame:
    """Features of every file as one JSON text each."""
    return features.select("path", F.to_json(F.struct("sources", "sinks", "complexity")).alias("features_json"))


def write_features(features: DataFrame, path: str) -> None:
    feature_json(features).select(F.concat_ws("\t", "path", "features_json").alias("text")).write.mode(
        "overwrite").text(path)
