"""Source files: from folders and from any table with text."""

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlines import session
from siftlines.functions import lookups, text

# Bytes of a piece of a file that is read in pieces.
SEGMENT_BYTES = 32 << 20

# Files, and bytes of files, that a task hands on at a time; a larger file goes by itself.
_BATCH_FILES = 4096
_BATCH_BYTES = 8 << 20
# Tasks for each core that read a folder: a task for every few files costs more than the files, if there are many.
_TASKS_A_CORE = 32

_LISTING = "path string, folder boolean"
_CONTENT = "path string, raw binary, error string"

# Supported extensions in either case, as a file name glob.
_NAMES = "*.{[pP][yY],[jJ][sS],[jJ][aA][vV][aA],[cC]}"


def files_from_table(rows: DataFrame, path: Column, content: Column, language: Column | None = None) -> DataFrame:
    """files(path, content, language) from any table; language by extension if not given."""
    named = rows.select(path.alias("path"), content.alias("content"),
                        (language if language is not None else text.language_of(path)).alias("language"))
    return named.where("language is not null")


def kept_by_pruning(path: Column, root: str) -> Column:
    """True when no folder between root and the file is one a scan skips."""
    folders = F.split(text.relative_path(path, root), "/")
    folders = F.slice(folders, 1, F.size(folders) - 1)
    return ~F.exists(folders, lambda d: d.startswith(".") | d.isin(*lookups.SKIPPED_FOLDERS))


def read_folder(spark: SparkSession, root: str, recursive: bool = True, prune: bool = True) -> DataFrame:
    """files(path, content, language) below a folder of any file system Spark reads.

    Spark hides names that start with ``_`` or ``.``; see ``read_shared_folder``.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", _NAMES)
    found = reader.option("recursiveFileLookup", recursive).load(root).coalesce(_TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    base = root.split("://")[-1].replace("file:", "")
    path = F.regexp_replace("path", r"^[a-z0-9]+:(//)?", "")
    named = found.select(path.alias("path"), "content").withColumn("language", text.language_of(F.col("path")))
    kept = named.where("language is not null")
    if prune:
        kept = kept.where(kept_by_pruning(F.col("path"), base))
    return kept.select("path", text.make_text(F.col("content")).alias("content"), "language")


def _joined_lines(most: int):
    """Lines of a byte range of a file, in order, as pieces of about ``most`` bytes."""
    def join(batches):
        at, held, size = None, [], 0

        def piece():
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]]), pa.array([at[1] + at[2]], pa.int64()), pa.array([b"".join(held)], pa.binary())],
                ["path", "seg", "raw"])

        for batch in batches:
            for path, block, line in zip(*(column.to_pylist() for column in batch.columns)):
                if at is not None and (at[:2] != (path, block) or size >= most):
                    yield piece()
                    at, held, size = (path, block, at[2] + size) if at[:2] == (path, block) else None, [], 0
                at = at or (path, block, 0)
                held += [line, b"\n"]
                size += len(line) + 1
        if held:
            yield piece()

    return join


def read_segments(spark: SparkSession, root: str, prune: bool = True, most: int = SEGMENT_BYTES) -> DataFrame:
    """segments(path, language, seg, content) below a folder, for files too large for one row.

    Byte ranges of a file (``spark.sql.files.maxPartitionBytes``) are read by different tasks; their lines are put
    together to pieces of about ``most`` bytes where they were read.  ``seg`` rises along a file.  Names as in ``read_folder``.
    """
    reader = spark.read.option("lineSep", "\n").option("pathGlobFilter", _NAMES).option("recursiveFileLookup", True)
    name = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", r"^[a-z0-9]+:/(//)?", "/"), F.lit("+"), F.lit("%2B")))
    lines = reader.text(root).select(
        name.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    pieces = lines.mapInArrow(_joined_lines(most), "path string, seg long, raw binary")
    named = pieces.select("path", text.language_of(F.col("path")).alias("language"), "seg", text.make_text(F.col("raw")).alias("content"))
    kept = named.where("language is not null")
    return kept.where(kept_by_pruning(F.col("path"), root.split("://")[-1].replace("file:", ""))) if prune else kept


def decoded_files(raw: DataFrame) -> DataFrame:
    """files(path, content, language, error) of raw(path, raw, error), without files of other kinds."""
    return raw.select(
        "path", text.make_text(F.col("raw")).alias("content"),
        text.language_of(F.col("path")).alias("language"), "error").where("language is not null")


def _list_folders(batches):
    names = ["path", "folder"]
    for batch in batches:
        rows = []
        for folder in batch.column(0).to_pylist():
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        # Folders are real paths, so only a link leads elsewhere.
                        real = os.path.realpath(e.path) if e.is_symlink() and os.path.exists(e.path) else e.path
                        rows.append((real, e.is_dir(follow_symlinks=False)))
                        if len(rows) >= _BATCH_FILES:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                            rows = []
            except OSError:
                continue
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


def _read_contents(batches):
    held, size = [], 0

    def full():
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(
            zip(*held), [pa.string(), pa.binary(), pa.string()])], ["path", "raw", "error"])

    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                with open(path, "rb") as file:
                    row = (path, file.read(), None)
            except OSError as problem:
                row = (path, None, str(problem))
            bytes_ = len(row[1] or b"")
            if held and (size + bytes_ > _BATCH_BYTES or len(held) >= _BATCH_FILES):
                yield full()
                held, size = [], 0
            held.append(row)
            size += bytes_
    if held:
        yield full()


def read_shared_folder(spark: SparkSession, root: str, recursive: bool = True, prune: bool = True) -> DataFrame:
    """files(path, content, language, error) of a folder every executor can open.

    Reads names Spark would hide, such as ``__init__.py``.  Tasks list one
    level of folders at a time and then read the files; the driver only sees
    whether another level is left.  A file that cannot be read keeps its error.
    """
    level = spark.createDataFrame([(os.path.realpath(root),)], "path string")
    found = None
    run = session.Run(spark)  # a few rows per folder
    # Named, since few bytes of paths may stand for many files, and would be put into one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        listed = level.mapInArrow(_list_folders, _LISTING)
        name = F.element_at(F.split("path", "/"), -1)
        here = listed.where(~F.col("folder")).select("path")
        found = here if found is None else found.unionByName(here)
        if not recursive:
            break
        level = listed.where("folder").select("path")
        if prune:
            level = level.where(~name.startswith(".") & ~name.isin(*lookups.SKIPPED_FOLDERS))
        # Written, so that the next level does not list this one again.
        level = run.keep(level.repartition(tasks, "path"))
        if level.isEmpty():
            break
    # Paths are made distinct, and so dealt out, before a file is opened.
    wanted = found.where(text.language_of(F.col("path")).isNotNull()).select("path").repartition(tasks, "path").distinct()
    contents = wanted.mapInArrow(_read_contents, _CONTENT)
    return decoded_files(contents)


def _written(root):
    def write(batches):
        made = set()
        for batch in batches:
            for path, content in zip(*(column.to_pylist() for column in batch.columns)):
                target = os.path.join(root, path)
                folder = os.path.dirname(target)
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                part = f"{target}.{os.getpid()}.part"
                with open(part, "wb") as file:
                    file.write(content.encode("utf-8", "replace"))
                os.replace(part, target)  # a task that is run again leaves the same file
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
    return write


def write_shared_folder(files: DataFrame, root: str) -> int:
    """Write files(path, content), paths relative, below a folder every executor can open; their number."""
    written = files.select("path", "content").mapInArrow(_written(root), "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def good(files: DataFrame) -> DataFrame:
    return files.where("error is null")


def errored(files: DataFrame) -> DataFrame:
    return files.where("error is not null")
