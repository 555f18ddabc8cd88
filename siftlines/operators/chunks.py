"""Findings per chunk, chunk results per file, and the whole-file narrative."""

from pyspark.sql import Column, DataFrame, functions as F

from siftlines.functions import lookups
from siftlines.functions.text import let, strip
from siftlines.operators import score

# Width, in lines, of the buckets a range join is made an equi-join with.
BUCKET_LINES = 64


def tag_findings(findings: DataFrame, bounds: DataFrame, bucket: int = BUCKET_LINES) -> DataFrame:
    """Findings with the chunk they lie in; those outside every chunk are dropped.

    Chunks are listed once per bucket of lines they touch, so a finding meets
    only the chunks around it and not every chunk of its file.
    """
    spread = bounds.select(
        F.col("path").alias("file"), "chunk_id", F.col("name").alias("original_chunk"), "start_line", "end_line",
        F.explode(F.sequence(F.floor(F.col("start_line") / bucket),
                             F.floor((F.greatest(F.col("end_line"), F.col("start_line") + 1) - 1) / bucket))
                  ).alias("bucket"))
    placed = findings.withColumn("bucket", F.floor((F.col("line") - 1) / bucket))
    inside = (F.col("line") > F.col("start_line")) & (F.col("line") <= F.col("end_line"))
    return placed.join(spread, ["file", "bucket"]).where(inside).select(
        *findings.columns, "original_chunk", "chunk_id")


def remap_lines(findings: DataFrame, bounds: DataFrame) -> DataFrame:
    """Findings of chunk texts, addressed in the original file.

    ``findings.file`` is ``path#chunk_id``, as ``chunk_files`` names them.
    """
    own = bounds.select("path", "chunk_id", F.col("name").alias("original_chunk"), "start_line")
    split = findings.withColumns({
        "path": F.regexp_extract("file", r"^(.*)#(\d+)$", 1),
        "chunk_id": F.regexp_extract("file", r"^(.*)#(\d+)$", 2).cast("int")})
    joined = split.join(own, ["path", "chunk_id"])
    return joined.withColumns({"file": F.col("path"), "line": F.col("line") + F.col("start_line")}).select(
        *findings.columns, "original_chunk", "chunk_id")


def chunk_files(texts: DataFrame) -> DataFrame:
    """Chunk texts as files of their own."""
    return texts.select(F.concat("path", F.lit("#"), F.col("chunk_id").cast("string")).alias("path"),
                        F.col("text").alias("content"), "language")


def chunk_scores(tagged: DataFrame, bounds: DataFrame) -> DataFrame:
    """Severity-first score of every chunk, 0 without findings."""
    scored = score.severity_scores(tagged, "file", "chunk_id").select(
        F.col("file").alias("path"), "chunk_id", "n_findings", "risk_score")
    return bounds.join(scored, ["path", "chunk_id"], "left").withColumns({
        "n_findings": F.coalesce("n_findings", F.lit(0)),
        "risk_score": F.coalesce("risk_score", F.lit(0.0))})


def file_rollup(chunks: DataFrame, seconds: Column | None = None) -> DataFrame:
    """Per file: its chunks, findings, worst chunk, risky chunks and total time."""
    return chunks.groupBy("path").agg(
        F.count("*").alias("n_chunks"),
        F.sum("n_findings").alias("n_findings"),
        F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("top_score"),
        F.count_if(F.col("risk_score") >= lookups.RISKY_CHUNK_SCORE).alias("n_risky"),
        F.coalesce(F.sum(seconds if seconds is not None else F.lit(0.0)), F.lit(0.0)).alias("total_seconds"))


def usable(summary: Column) -> Column:
    """A summary as a list item, or null when there is none."""
    text = strip(summary)
    return F.when((text != "") & (text != lookups.NO_SUMMARY),
                  F.translate(F.rtrim(text, F.lit(".")), "\n", " "))


def _joined(items: Column, limit: int, mark: str) -> Column:
    return F.array_join(F.slice(items, 1, limit), mark)


def narratives(chunks: DataFrame, openings: DataFrame | None = None) -> DataFrame:
    """Whole-file narrative from chunks(path, language, chunk_id, name, summary,
    risk_score, n_findings).

    A file's chunks are parts of one value, so a list of them is bounded by it.
    ``module_prompt`` is what a summariser may be given to write an opening; ``openings`` has what it
    wrote (path, opening).  An opening that speaks of vulnerabilities where none were found is replaced.
    """
    part = F.struct("chunk_id", usable(F.col("summary")).alias("text"))
    risky = F.struct("chunk_id", F.col("name").alias("text"))
    gathered = chunks.groupBy("path", "language").agg(
        F.count("*").alias("n_chunks"), F.sum("n_findings").alias("n_findings"),
        F.array_sort(F.collect_list(F.when(usable(F.col("summary")).isNotNull(), part))).alias("parts"),
        F.array_sort(F.collect_list(F.when(F.col("risk_score") >= lookups.RISKY_CHUNK_SCORE, risky))).alias("risky"))
    texts = gathered.withColumns({
        "parts": F.transform("parts", lambda p: p["text"]),
        "risky": F.transform("risky", lambda p: p["text"])})
    calm = F.filter("parts", lambda p: ~F.lower(p).contains("vulner") & ~F.lower(p).contains("security"))
    behaviours = let(calm, lambda c: F.when(F.size(c) > 0, c).otherwise(F.col("parts")))
    if openings is None:
        texts = texts.withColumn("opening", F.lit(None).cast("string"))
    else:
        texts = texts.join(openings.select("path", "opening"), "path", "left")
    return texts.withColumn("behaviours", behaviours).select(
        "path", "language", "n_chunks", "n_findings", _module_prompt().alias("module_prompt"),
        _narrative().alias("narrative"))


# fixed values: the sentences of a narrative and of the prompt for its opening
def _opening() -> Column:
    own = F.col("opening")
    wrong = F.lower(own).contains("vulnerabilities") & (F.col("n_findings") == 0)
    chosen = (F.when(own.isNull(), F.concat(F.lit("This module implements functional logic in "), F.col("language")))
              .when(wrong, F.concat(F.lit("This module provides core logic and functionality for the "),
                                    F.col("language"), F.lit(" application"))).otherwise(own))
    return F.concat(chosen, F.when(F.endswith(chosen, F.lit(".")), "").otherwise("."))


def _narrative() -> Column:
    found = F.col("n_findings")
    return F.btrim(F.concat(
        _opening(), F.lit(" "),
        F.lit("During the chunked analysis, the file was partitioned into "),
        F.col("n_chunks").cast("string"), F.lit(" logical components. "),
        F.when(found == 0, "Static analysis verified that this code is structurally sound and secure, "
                           "with no vulnerabilities detected across its components. ")
        .otherwise(F.concat(
            F.lit("A total of "), found.cast("string"), F.lit(" security vulnerabilities were detected. "),
            F.when(F.size("risky") > 0, F.concat(
                F.lit("Urgent security attention is required in the more vulnerable segments: "),
                _joined(F.col("risky"), 3, ", "), F.lit(". ")))
            .otherwise("The vulnerabilities are primarily minor warnings or info-level findings "
                       "spread across the file. "))),
        F.when(F.size("behaviours") > 0, F.concat(
            F.lit("Functionally, the key behaviors and responsibilities encapsulated by this code include: "),
            _joined(F.col("behaviours"), 3, "; "), F.lit("."))).otherwise("")))


def _module_prompt() -> Column:
    head = F.concat(F.lit("// Language: "), F.col("language"), F.lit("\n"))
    plain = F.lit("// General application module.\nfunction execute_module() {}\n")
    listed = F.concat(F.lit("// Implements the following features: "), _joined(F.col("parts"), 4, "; "),
                      F.lit(".\nfunction get_module_features() {}\n"))
    return F.substring(F.concat(head, F.when(F.size("parts") > 0, listed).otherwise(plain)), 1, 1000)
