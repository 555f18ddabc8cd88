"""Files grouped by their top folder."""

from pyspark.sql import DataFrame, functions as F

from siftlines.functions.text import base_name, strip, top_folder, truncate
from siftlines.operators.groups import with_totals


def entries(results: DataFrame) -> DataFrame:
    """entries(group, file, entry, n_files) of results(file, summary).

    A group's size is joined back cell by cell; entries stay rows, so a folder
    that holds most files is spread like any other rows.
    """
    text = strip(F.coalesce("summary", F.lit("")))
    named = results.where(text != "").select(
        top_folder(F.col("file")).alias("group"), "file",
        truncate(F.concat(base_name(F.col("file")), F.lit(" — "), text), 72).alias("entry"))
    return with_totals(named, "group", "file", {"n_files": (F.count("*"), F.sum)})


def totals(results: DataFrame) -> DataFrame:
    """One row: files with a summary, and groups they are in."""
    groups = results.where(strip(F.coalesce("summary", F.lit(""))) != "").groupBy(
        top_folder(F.col("file")).alias("group")).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.count("*").alias("n_groups"))
