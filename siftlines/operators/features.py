"""Per-file features: calls that bring data in or use it, and complexity."""

from pyspark.sql import Column, DataFrame, functions as F

from siftlines.functions import lexical


def features(files: DataFrame, *carry: Column) -> DataFrame:
    """features(path, language, sources, sinks, complexity) of files; no shuffle.

    ``carry`` are further named expressions over the files, worked out in the
    same pass.
    """
    masked = files.select("path", "language", *carry,
                          lexical.masked(F.col("content"), F.col("language")).alias("code"))
    called = masked.withColumn("calls", lexical.calls(F.col("code"), F.col("language")))
    return called.withColumns({
        "sources": lexical.sources(F.col("calls"), F.col("language")),
        "sinks": lexical.sinks(F.col("calls"), F.col("language")),
        "complexity": lexical.complexity(F.col("code"), F.col("language"))}).drop("code", "calls")


def call_sites(files: DataFrame) -> DataFrame:
    """One row per call: its name and its position in the file."""
    masked = files.select("path", "language",
                          lexical.masked(F.col("content"), F.col("language")).alias("code"))
    return masked.select("path", "language", F.posexplode(
        lexical.calls(F.col("code"), F.col("language"))).alias("call_no", "call"))


_SCRIPT = r"<script[^>]*>([\s\S]*?)</script>"


def script_files(pages: DataFrame) -> DataFrame:
    """The script elements of HTML pages(path, html) as JavaScript files."""
    return pages.select(
        F.col("path"),
        F.array_join(F.regexp_extract_all("html", F.lit(_SCRIPT), 1), "\n").alias("content"),
        F.lit("javascript").alias("language"))
