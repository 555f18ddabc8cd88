"""The three audits: a folder, a large file, a single file.

What an audit reads several times goes through ``keep``: by default it is written once as Parquet below the shared checkpoint
folder.  With the ``keep`` of a ``session.Run`` of the caller's it can be removed afterwards; with
``session.lazily`` building an audit starts no job, and shared parts are worked out again for each output.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from siftlines.functions import lookups, summary, text
from siftlines.functions.classify import finding_row, risk_label, with_snippet
from siftlines.operators import blocks, chunks, features, findings as find, overview, scan, score
from siftlines.session import Run

Keep = Callable[[DataFrame], DataFrame]
FINDING = ["check_id", "file", "line", "message", "severity", "snippet"]


def _with_summaries(rows: DataFrame, summaries: DataFrame | None, *keys: str) -> DataFrame:
    """Summaries a model wrote, if any; the stock text where it wrote none."""
    if summaries is None:
        return rows.withColumn("summary", F.lit(lookups.NO_SUMMARY))
    return rows.join(summaries.select(*keys, "summary"), list(keys), "left").withColumn(
        "summary", F.coalesce("summary", F.lit(lookups.NO_SUMMARY)))


def chunk_results(files: DataFrame, found: DataFrame, summaries: DataFrame | None = None,
                  size: int = lookups.CHUNK_LINES, keep: Keep | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bounds, tagged findings, chunk results) of files and their line findings."""
    keep = keep or Run(files.sparkSession).keep
    # A few numbers per chunk, read several times: with a run the files are not read again.
    bounds = keep(blocks.chunk_bounds(files, size, "language"))
    tagged = chunks.tag_findings(found, bounds)
    results = _with_summaries(chunks.chunk_scores(tagged, bounds), summaries, "path", "chunk_id")
    return bounds, tagged, results


def chunk_details(files: DataFrame, tagged: DataFrame, size: int = lookups.CHUNK_LINES) -> DataFrame:
    """(path, chunk_id, sources, sinks, complexity, findings, prompt) of every chunk.

    Features and the start of the code are taken from a chunk's text where the file is read; the text stays there.
    """
    texts = blocks.chunk_texts(files, size).withColumnRenamed("text", "content")
    start = F.substring("content", 1, lookups.PROMPT_CODE_CHARS).alias("start")
    described = features.features(texts, F.col("chunk_id"), start)
    order = ["rule_ord", "line"]
    note = summary.finding_note(F.col("severity"), F.col("message"), F.col("line")).alias("note")
    listed = F.struct(*order, note, F.struct(*FINDING, "original_chunk", "chunk_id").alias("finding"))
    gathered = tagged.groupBy(F.col("file").alias("path"), "chunk_id").agg(F.array_sort(F.collect_list(listed)).alias("listed"))
    notes = F.coalesce(F.transform("listed", lambda x: x["note"]), F.array().cast("array<string>"))
    return described.join(gathered, ["path", "chunk_id"], "left").select(
        "path", "chunk_id", "sources", "sinks", "complexity", F.transform("listed", lambda x: x["finding"]).alias("findings"),
        summary.prompt(notes, F.col("sources"), F.col("sinks"), F.col("complexity"), F.col("start")).alias("prompt"))


def large_file_audit(files: DataFrame, summaries: DataFrame | None = None, size: int = lookups.CHUNK_LINES,
                     openings: DataFrame | None = None, keep: Keep | None = None) -> dict[str, DataFrame]:
    """Chunk by chunk: chunk results, distinct findings by line and as table rows, categories,
    one narrative and one total row per file."""
    keep = keep or Run(files.sparkSession).keep
    bounds, tagged, scored = chunk_results(files, keep(scan.scan(files)), summaries, size, keep)
    scored = keep(scored)
    distinct = find.distinct_findings(tagged, "chunk_id", "rule_ord", "line")
    counted = distinct.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("n_findings"))
    totals = chunks.file_rollup(scored).drop("n_findings").join(counted, "path", "left").withColumn(
        "n_findings", F.coalesce("n_findings", F.lit(0)))
    row = finding_row(F.col("line"), F.col("severity"), F.col("message"), F.col("original_chunk"), "  ")
    table = find.line_snippets(distinct, files).select(
        "file", "line", "rule_ord", with_snippet(row, F.col("source_line"), "  ").alias("row"))
    return {
        "chunks": scored.join(chunk_details(files, tagged, size), ["path", "chunk_id"]).orderBy("path", "chunk_id"),
        "findings": distinct.orderBy("file", "line", "rule_ord"),
        "table": table.orderBy("file", "line", "rule_ord"),
        "categories": find.category_counts(distinct),
        "narratives": chunks.narratives(scored, openings),
        "totals": totals.withColumn("label", risk_label(F.col("top_score"))),
    }


def single_file_audit(files: DataFrame, primary: DataFrame | None = None, keep: Keep | None = None) -> dict[str, DataFrame]:
    """Severity-first score, features and prompt of every file."""
    keep = keep or Run(files.sparkSession).keep
    found = keep(scan.scan(files) if primary is None else scan.with_fallback(files, primary))
    scores = score.severity_scores(found, "file").select(F.col("file").alias("path"), "n_findings", "risk_score")
    described = features.features(files).join(scores, "path", "left").withColumns({
        "n_findings": F.coalesce("n_findings", F.lit(0)), "risk_score": F.coalesce("risk_score", F.lit(0.0))})
    return {
        "files": described.withColumn("label", risk_label(F.col("risk_score"))),
        "findings": found.orderBy("file", "rule_ord", "line"),
        "prompts": prompts(files, found),
    }


def finding_notes(found: DataFrame) -> DataFrame:
    """notes(path, notes) in the order found; a file bounds its own list."""
    note = F.struct("rule_ord", "line", summary.finding_note(
        F.col("severity"), F.col("message"), F.col("line")).alias("note"))
    return found.groupBy(F.col("file").alias("path")).agg(
        F.transform(F.array_sort(F.collect_list(note)), lambda n: n["note"]).alias("notes"))


def prompts(files: DataFrame, found: DataFrame, named: bool = False) -> DataFrame:
    """Prompt of every file, with its name on top of the code if asked for."""
    code = F.col("content")
    code = summary.named_code(F.col("path"), code) if named else code
    # Only the first characters of a file go into a prompt, so only they move.
    start = F.substring(code, 1, lookups.PROMPT_CODE_CHARS).alias("start")
    return features.features(files, start).join(finding_notes(found), "path", "left").select(
        "path", summary.prompt(F.coalesce("notes", F.array().cast("array<string>")), F.col("sources"),
                               F.col("sinks"), F.col("complexity"), F.col("start")).alias("prompt"))


def folder_audit(files: DataFrame, primary: DataFrame | None = None, summaries: DataFrame | None = None,
                 chunk_summaries: DataFrame | None = None, big_lines: int = lookups.BIG_FILE_LINES,
                 openings: DataFrame | None = None, keep: Keep | None = None) -> dict[str, DataFrame]:
    """Findings, one result row per file, and the errors of a whole corpus.

    Files of more than ``big_lines`` lines go through chunks: their chunks' findings are
    merged in and their summary is the narrative.
    """
    keep = keep or Run(files.sparkSession).keep
    has_errors = "error" in files.columns
    readable = files.where("error is null") if has_errors else files
    readable = readable.where(F.col("language").isNotNull()).select("path", "content", "language")
    # One scan serves the fallback of every file and the chunks of the big ones.
    scanned = keep(scan.scan(readable))
    found = scanned if primary is None else scan.first_found(primary, scanned)

    is_big = text.newline_count(F.col("content")) > big_lines
    bounds, tagged, chunk_rows = chunk_results(readable.where(is_big), scanned, chunk_summaries, keep=keep)
    # Every big file has chunks, so their paths need no second look at the contents.
    big_paths = bounds.select(F.col("path").alias("file")).distinct()
    own = found.join(big_paths, "file", "left_semi")
    merged = find.distinct_findings(
        own.withColumn("origin", F.lit(0)).unionByName(
            tagged.withColumn("origin", F.lit(1)), allowMissingColumns=True),
        "origin", "rule_ord").drop("origin")
    final = keep(found.join(big_paths, "file", "left_anti").unionByName(merged, allowMissingColumns=True))

    described = features.features(
        readable, text.newline_count(F.col("content")).alias("line_count"), is_big.alias("big_file"),
        text.reader_line_count(F.col("content")).alias("reader_lines")).withColumnRenamed("path", "file")
    base = score.with_density(described, final).drop("reader_lines")
    told = chunks.narratives(chunk_rows, openings).select(F.col("path").alias("file"), "narrative")
    described = base.join(told, "file", "left")
    if summaries is not None:
        described = described.join(summaries.select(F.col("path").alias("file"), "summary"), "file", "left")
    else:
        described = described.withColumn("summary", F.lit(None).cast("string"))
    results = keep(described.withColumn(
        "summary", F.coalesce("narrative", "summary", F.lit(lookups.NO_SUMMARY))).drop("narrative"))
    errors = (files.where("error is not null").select(F.col("path").alias("file"), "error") if has_errors
              else files.sparkSession.createDataFrame([], "file string, error string"))
    return {"findings": final, "results": results, "errors": errors}


def nested_results(audit: dict[str, DataFrame]) -> DataFrame:
    """File results with their findings inside, as the JSON report has them."""
    fields = F.struct("rule_ord", "line", "check_id", "message", "severity", "snippet")
    listed = audit["findings"].groupBy("file").agg(F.array_sort(F.collect_list(fields)).alias("found"))
    as_finding = lambda f: F.struct(
        f["check_id"].alias("check_id"), F.col("file"), f["line"].alias("line"), f["message"].alias("message"),
        f["severity"].alias("severity"), f["snippet"].alias("snippet"))
    good = audit["results"].join(listed, "file", "left").select(
        "file", "language", "line_count", "big_file", "risk_score",
        F.transform(F.coalesce("found", F.array().cast("array<struct<rule_ord:int,line:int,check_id:string,"
                                                       "message:string,severity:string,snippet:string>>")),
                    as_finding).alias("findings"),
        F.struct("sources", "sinks", "complexity").alias("features"), "summary",
        F.lit(None).cast("string").alias("error"))
    return good.unionByName(audit["errors"], allowMissingColumns=True)


# fixed values: the texts of the project report
BAR = "=" * 65
RULE = "─" * 63
HEADINGS = {1: "PROJECT OVERVIEW", 3: "SECURITY STATS", 4: "TOP RISKIEST FILES", 5: "MOST COMMON VULNERABILITY TYPES",
            6: "CROSS-FILE VULNERABILITY PATTERNS", 7: "PER-FILE AI SUMMARIES"}
NO_FILES = "\n  [!] No files could be analyzed."
NO_SUMMARIES = "No summaries could be generated."
COUNTS = [("  Total Issues : %d", "total"), ("    High Vulnerability   : %d", "high"),
          ("    Medium Vulnerability : %d", "medium"), ("    Low Vulnerability    : %d", "low")]
# A place before any row of a section.
_TOP = -2**40


def project_map(audit: dict[str, DataFrame], root: str = "") -> DataFrame:
    """The project report as lines(section, first, second, third, text), in order.

    Sections that list files stay distributed; the final sort is a range
    partitioning by section and name.  A section without rows has no heading.
    """
    relative = lambda c: text.relative_path(c, root) if root else c
    results = audit["results"].withColumn("file", relative(F.col("file")))
    found = audit["findings"].withColumn("file", relative(F.col("file")))
    errors = audit["errors"].withColumn("file", relative(F.col("file")))
    spark = results.sparkSession

    def line(section, body, first=F.lit(""), second=F.lit(0), third=F.lit("")):
        return [F.lit(section).alias("section"), first.cast("string").alias("first"),
                second.cast("long").alias("second"), third.cast("string").alias("third"), body.alias("text")]

    def heading(section, some):
        """Its heading if ``some`` has a row."""
        return some.select(F.lit(1).alias("n")).limit(1).select(*line(
            section, F.lit(f"\n  {RULE}\n  {HEADINGS[section]}\n  {RULE}"), second=F.lit(_TOP)))

    # Good and errored files, as one row.
    sized = results.agg(F.count("*").alias("good")).select("good", F.lit(1).alias("k")).join(
        errors.agg(F.count("*").alias("bad")).select("bad", F.lit(1).alias("k")), "k")
    parts = [spark.range(1).select(*line(0, F.lit(f"{BAR}\n  PROJECT-LEVEL SECURITY MAP\n  Directory : {root}"), second=F.lit(0))),
             sized.select(*line(0, F.format_string("  Files     : %d", F.col("good") + F.col("bad")), second=F.lit(1))),
             spark.range(1).select(*line(0, F.lit(BAR), second=F.lit(2))),
             sized.where("good = 0").select(*line(0, F.lit(NO_FILES), second=F.lit(3))),
             heading(1, results)]
    totals = overview.totals(results)
    parts.append(totals.where("n_files > 0").select(*line(1, F.format_string(
        "Project contains %d source file(s) across %d component(s):", "n_files", "n_groups"))))
    parts.append(totals.withColumn("k", F.lit(1)).join(sized, "k").where("n_files = 0 and good > 0").select(
        *line(1, F.lit(NO_SUMMARIES))))
    listed = overview.entries(results)
    parts.append(listed.groupBy("group").agg(F.max("n_files").alias("n")).select(*line(
        2, F.format_string("\n  [%s]  (%d file(s))", "group", "n"), F.col("group"))))
    parts.append(listed.select(*line(2, F.concat(F.lit("    * "), "entry"), F.col("group"), F.lit(1), F.col("file"))))
    stats = find.severity_totals(found).withColumn("k", F.lit(1)).join(sized, "k").where("good > 0")
    parts.append(heading(3, results))
    for number, (label, column) in enumerate(COUNTS):
        parts.append(stats.select(*line(3, F.format_string(label, column), second=F.lit(number))))
    top = find.top_files(results, 5)
    parts += [heading(4, results), top.select(*line(
        4, F.format_string("  [%-8s] %4.1f/10  %s  (%d finding(s))", risk_label(F.col("risk_score")), "risk_score",
                           "file", "n_findings"), second=-F.col("risk_score") * 10, third=F.col("file")))]
    parts += [heading(5, found), find.category_counts(found, 10).select(*line(
        5, F.format_string("  %d. %-28s — %d occurrence(s)", "rank", "category", "n_findings"), second=F.col("rank")))]
    cross = find.cross_file_rules(found)
    parts += [heading(6, cross), cross.select("check_id", "n_files").distinct().select(*line(
        6, F.concat(F.lit("  "), "check_id"), F.lit(""), -F.col("n_files"), F.col("check_id")))]
    parts.append(cross.select(*line(6, F.concat(F.lit("     → "), "file"), F.lit(""), -F.col("n_files"),
                                    F.concat("check_id", F.lit("\t"), "file"))))
    tag = F.when(F.col("big_file"), "  [BIG-FILE]").otherwise("")
    parts += [heading(7, results), results.select(*line(
        7, F.concat(F.lit("\n  "), "file", F.lit("  ["), risk_label(F.col("risk_score")), F.lit("  "),
                    F.format_string("%.1f", "risk_score"), F.lit("/10]"), tag), F.col("file"), F.lit(-3)))]
    parts.append(results.select(*line(7, F.concat(F.lit("  "), "summary"), F.col("file"), F.lit(-2))))
    parts.append(results.where("n_findings > 0").select(*line(
        7, F.format_string("    Vulnerabilities (%d):", "n_findings"), F.col("file"), F.lit(-1))))
    chunk = F.col("original_chunk") if "original_chunk" in found.columns else F.lit("")
    parts.append(found.select(*line(
        7, finding_row(F.col("line"), F.col("severity"), F.col("message"), chunk, "    "),
        F.col("file"), F.col("line"), F.format_string("%05d", "rule_ord"))))
    parts += [errors.select(F.lit(1).alias("n")).limit(1).select(*line(
        8, F.lit(f"\n  {RULE}\n  FILES WITH ERRORS (skipped)"), second=F.lit(_TOP)))]
    parts.append(errors.select(*line(8, F.concat(F.lit("  "), "file", F.lit(" — "), "error"), F.col("file"))))
    parts.append(sized.where("good > 0").select(*line(9, F.lit(f"\n{BAR}\n"))))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.orderBy("section", "first", "second", "third")
