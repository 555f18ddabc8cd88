"""Files to lines, and lines to fixed-size windows."""

from pyspark.sql import Column, DataFrame, functions as F

from siftlines.functions import lookups, text


def scan_lines(files: DataFrame, *carry: str) -> DataFrame:
    """One row per line, numbered from 1.

    Expands each file where it lies: no shuffle.  ``carry`` names further file
    columns to keep on every line.
    """
    return _explode(files, text.split_lines(F.col("content")), carry)


def reader_lines(files: DataFrame, *carry: str) -> DataFrame:
    """As ``scan_lines``, but only newlines end a line."""
    return _explode(files, text.read_lines(F.col("content")), carry)


def _explode(files: DataFrame, lines: Column, carry) -> DataFrame:
    return files.select("path", *carry, F.posexplode(lines).alias("pos", "text")).select(
        "path", *carry, (F.col("pos") + 1).alias("line"), "text")


def line_counts(files: DataFrame) -> DataFrame:
    """Both line counts a file can have; they differ on a final newline."""
    return files.select(
        "path",
        text.newline_count(F.col("content")).alias("line_count"),
        text.reader_line_count(F.col("content")).alias("reader_lines"))


def line_windows(files: DataFrame, size: int = lookups.CHUNK_LINES, *carry: str) -> DataFrame:
    """Cut every file into windows of ``size`` lines; ``carry`` names file columns to keep.

    The windows are slices of the file's own line array, so nothing moves.
    """
    split = files.select("path", *carry, text.split_lines(F.col("content")).alias("lines"))

    def window(start, number):
        end = F.least(start + size, F.size("lines"))
        return F.struct(
            number.alias("chunk_id"), F.format_string("lines_%d_to_%d", start + 1, end).alias("name"),
            F.array_join(F.slice("lines", start + 1, F.lit(size)), "\n").alias("text"),
            start.alias("start_line"), end.alias("end_line"))

    # Texts are cut before the windows become rows, so no row carries its whole file.
    starts = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1, F.lit(size)))
    return split.select("path", *carry, F.inline(F.transform(starts, window)))


def row_windows(rows: DataFrame, key: str, order: Column, value: Column,
                size: int = lookups.CHUNK_LINES) -> DataFrame:
    """``line_windows`` for a table that already holds one row per line.

    ``order`` is the zero-based position of a row within ``key``.  A group is
    one window, so it never holds more than ``size`` rows however large a key is.
    """
    start = (F.floor(order / size) * size).cast("int")
    return (rows.select(key, start.alias("start_line"), F.struct(order.alias("o"), value.alias("v")).alias("row"))
            .groupBy(key, "start_line")
            .agg(F.array_sort(F.collect_list("row")).alias("rows"))
            .select(key,
                    (F.col("start_line") / size).cast("int").alias("chunk_id"),
                    F.format_string("lines_%d_to_%d", F.col("start_line") + 1,
                                    F.col("start_line") + F.size("rows")).alias("name"),
                    F.array_join(F.transform("rows", lambda r: r["v"]), "\n").alias("text"),
                    "start_line"))
