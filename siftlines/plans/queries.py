"""The registered queries: every operator run over the whole given tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlines import session
from siftlines.functions import catalog, classify, summary, text
from siftlines.operators import (blocks, calls, chunks, features, findings as find, lines, metrics, overview, scan,
                                 score, segments, sequence)
from siftlines.plans import audits, corpus
from siftlines.sources import files as file_source, reports, scanner_json
from siftlines.streaming import rollup

FINDING = ["check_id", "file", "line", "message", "severity", "snippet"]

# A user's rules, as rows: id, language, position, severity, message, pattern.
USER_RULES = [
    ("user.token", "python", 0, "ERROR", "[CWE-798] Token in code.", r"\btoken\s*=\s*[\"'][^\"']+[\"']"),
    ("user.call", "python", 1, "INFO", "Call of print or eval.", r"\b(print|eval)\s*\("),
    ("user.call", "python", 2, "WARNING", "Call of eval or of a loader.", r"\b(eval|\w+\.loads)\s*\("),
    ("user.number", "shared", 9, "INFO", "Backslash and d, or a long number.", r"\\d|\d{4,}"),
    ("user.const", "javascript", 0, "INFO", "Constant.", r"\bconst\s+\w+"),
    ("user.class", "java", 0, "WARNING", "Upper or lower case class.", r"\bCLASS\s+\w+"),
    ("user.free", "c", 0, "WARNING", "Release.", r"\bfree\s*\(\s*\w+\s*\)"),
]
USER_RULES_SCHEMA = "rule_id string, language string, ord int, severity string, message string, pattern string"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _found(spark, sf_dir) -> DataFrame:
    return scan.scan(corpus.code_files(spark, sf_dir))


def _kept(spark, sf_dir) -> DataFrame:
    """Findings for a query that reads them more than once: the corpus is scanned once."""
    return session.cached(_found(spark, sf_dir))


def _primary(found: DataFrame) -> DataFrame:
    """What another scanner reports: the worst findings, as printed JSON read back."""
    return scanner_json.findings(scanner_json.to_scanner_json(found.where("severity = 'ERROR'")))


def _readings(spark, sf_dir) -> DataFrame:
    return rollup.readings_from_events(_read(spark, sf_dir, "events"))


def _marks(spark, sf_dir) -> DataFrame:
    return _readings(spark, sf_dir).select(
        "run_id", F.col("domain").alias("phase"), "at_us", F.col("sample_id").alias("mark_id"))


def _doc_results(spark, sf_dir) -> DataFrame:
    """Documents as file results: the first line is the summary."""
    docs = corpus.documents(spark, sf_dir)
    return docs.select(
        F.concat("source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        summary.clean_summary(F.substring_index("text", "\n", 1)).alias("summary"))


def _windows(spark, sf_dir, size: int = 4) -> DataFrame:
    return lines.line_windows(corpus.code_files(spark, sf_dir), size)


# scans ------------------------------------------------------------------------

def scan_secrets(spark, sf_dir):
    """Hits of the JavaScript and the Java rule on hard-coded secrets, as the query's SQL has them.

    Python's two rules do not apply to these files.  The shared rule on AWS keys does and is not run here, because the SQL does not
    have it; ``scan_all_rules`` runs every rule, over other files.
    """
    rules = [r for r in catalog.line_rules() if r.rule_id in
             ("fallback.js.secrets-hardcoded", "fallback.java.secrets-password")]
    return scan.scan(corpus.prose_files(spark, sf_dir), rules).select(*FINDING)


def scan_all_rules(spark, sf_dir):
    return _found(spark, sf_dir).select(*FINDING)


def scan_rule_file(spark, sf_dir):
    found = scan.scan(corpus.code_files(spark, sf_dir), catalog.rule_file_rules())
    return found.select("check_id", "file", "line", "message", "severity")


def scan_rule_table(spark, sf_dir):
    rules = spark.createDataFrame(USER_RULES, USER_RULES_SCHEMA)
    return scan.scan(corpus.code_files(spark, sf_dir), rules).select(*FINDING)


def _word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every word of the benchmark items, beside the user's rules."""
    word = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]{4,}"), 0)).alias("word")
    words = _read(spark, sf_dir, "benchmark").select(word).distinct()
    rules = words.select(F.concat(F.lit("word."), "word").alias("rule_id"), F.lit("shared").alias("language"), F.lit(20).alias("ord"),
                         F.lit("INFO").alias("severity"), F.concat(F.lit("Word "), "word", F.lit(".")).alias("message"),
                         F.concat(F.lit(r"\b"), "word", F.lit(r"\b")).alias("pattern"))
    return rules.unionByName(spark.createDataFrame(USER_RULES, USER_RULES_SCHEMA))


def scan_many_rules(spark, sf_dir):
    """Hits of a rule table with a rule for each of many words."""
    return scan.scan_with_rule_index(corpus.code_files(spark, sf_dir), _word_rules(spark, sf_dir)).select(
        "check_id", "file", "line", "severity")


def pattern_and_not(spark, sf_dir):
    files = corpus.guarded_files(spark, sf_dir)
    chosen = [r for r in catalog.rule_file_rules() if r.exclude]
    plain = [catalog.Rule(r.rule_id, r.language, r.severity, r.message, r.pattern, r.anchor) for r in chosen]
    counted = lambda rules, name: scan.scan(files, rules).groupBy("check_id").agg(F.count("*").alias(name))
    return counted(plain, "n_plain").join(counted(chosen, "n_kept"), "check_id", "left").withColumn(
        "n_kept", F.coalesce("n_kept", F.lit(0)))


def scan_html_lines(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select(F.col("url").alias("path"), "page_id", "html")
    scripts = features.script_files(pages.withColumn("path", F.col("page_id").cast("string")))
    return features.call_sites(scripts).groupBy("path", "call").agg(F.count("*").alias("n_calls"))


def rule_coverage(spark, sf_dir):
    rules = catalog.rule_file_table(spark).select(
        F.col("id").alias("check_id"), "severity", F.col("metadata.category").alias("kind"),
        F.col("metadata.cwe").alias("cwe"), F.element_at("languages", 1).alias("language"))
    hits = scan.scan(corpus.code_files(spark, sf_dir), catalog.rule_file_rules()).groupBy("check_id").agg(
        F.count("*").alias("n"))
    return rules.join(hits, "check_id", "left").withColumn("n_findings", F.coalesce("n", F.lit(0))).drop("n")


def sequence_rules(spark, sf_dir):
    return sequence.sequence_findings(corpus.code_files(spark, sf_dir)).select(*FINDING)


def call_rules(spark, sf_dir):
    """Calls over several lines that the rule file's rules on calls hit."""
    return calls.call_findings(corpus.spread_files(spark, sf_dir)).select(
        "check_id", "file", "line", "last_line", "message", "severity", "snippet")


def fallback_when_empty(spark, sf_dir):
    primary = _primary(_found(spark, sf_dir))
    return scan.with_fallback(corpus.code_files(spark, sf_dir), primary).select(*FINDING)


def json_findings(spark, sf_dir):
    noisy = scanner_json.to_scanner_json(_found(spark, sf_dir)).select(
        F.concat(F.lit("scan started\n"), "raw", F.lit("\ndone")).alias("raw"), "ord")
    return scanner_json.findings(noisy).select(*FINDING)


def bulk_json_findings(spark, sf_dir):
    """Whole-tree output with fields missing, joined to every file."""
    files = corpus.code_files(spark, sf_dir)
    partial = scan.scan(files).select(
        "check_id", "file", F.when(F.col("severity") != "INFO", F.col("line")).alias("line"),
        F.when(F.col("severity") != "INFO", F.col("message")).alias("message"),
        F.when(F.col("severity") != "INFO", F.lower("severity")).alias("severity"),
        F.concat(F.lit("\t "), "snippet", F.lit("\n")).alias("snippet"))
    bulk = scanner_json.bulk_findings(scanner_json.to_scanner_json(partial))
    return find.files_with_findings(files, bulk).select("language", *FINDING)


# findings -----------------------------------------------------------------------

def classify_messages(spark, sf_dir):
    found = _found(spark, sf_dir).select("file", "line", "check_id", "severity", F.explode(F.array(
        F.col("message"), F.regexp_replace("message", r"^\[[^\]]*\] ", ""))).alias("message"))
    return find.classified(found).withColumn("short", classify.short_message(F.col("message"))).select(
        "check_id", "file", "line", "message", "weakness", "category", "display_severity", "short")


def classify_lines(spark, sf_dir):
    """Every line of every document as a message."""
    docs = corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return lines.scan_lines(docs).groupBy(classify.category(F.col("text")).alias("category")).agg(
        F.count("*").alias("n_lines"))


def category_join(spark, sf_dir):
    return find.categories_by_join(_found(spark, sf_dir)).groupBy("weakness", "category").agg(
        F.count("*").alias("n_findings"))


def dedup_findings(spark, sf_dir):
    found = _kept(spark, sf_dir)
    copy = found.withColumns({"check_id": F.concat(F.lit("copy."), "check_id"), "origin": F.lit(1)})
    return find.distinct_findings(found.withColumn("origin", F.lit(0)).unionByName(copy), "origin", "rule_ord").select(
        *FINDING)


def new_findings(spark, sf_dir):
    """Findings the worst ones do not already hold as whole records."""
    found = _kept(spark, sf_dir).select(*FINDING)
    return find.new_findings(found, found.where("severity = 'ERROR'"))


def risk_severity_first(spark, sf_dir):
    files = corpus.code_files(spark, sf_dir)
    scored = score.severity_scores(scan.scan(files), "file").select("file", "n_findings", "risk_score")
    every = files.select(F.col("path").alias("file")).join(scored, "file", "left")
    risk = F.coalesce("risk_score", F.lit(0.0))
    return every.select(
        "file", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), risk.alias("risk_score"),
        classify.risk_label(risk).alias("label"), classify.panel_label(risk).alias("panel"),
        classify.gauge_percent(risk).alias("gauge"))


def risk_density(spark, sf_dir):
    files = corpus.code_files(spark, sf_dir)
    return score.density_scores(scan.scan(files), files)


def severity_counts(spark, sf_dir):
    return find.severity_counts(_found(spark, sf_dir))


def dashboard_counts(spark, sf_dir):
    found = _found(spark, sf_dir)
    odd = found.withColumn("severity", F.when(F.col("line") < 5, "critical").otherwise(F.col("severity")))
    return find.dashboard_counts(odd)


def category_counts(spark, sf_dir):
    return find.category_counts(_found(spark, sf_dir))


def top_categories(spark, sf_dir):
    return find.category_counts(_found(spark, sf_dir), 10)


def cross_file_rules(spark, sf_dir):
    return find.cross_file_rules(_kept(spark, sf_dir))


def top_risky_files(spark, sf_dir):
    scored = score.severity_scores(_found(spark, sf_dir), "file").select("file", "n_findings", "risk_score")
    return find.top_files(scored, 5).withColumn("label", classify.risk_label(F.col("risk_score")))


def top_secret_documents(spark, sf_dir):
    """Documents as they are, by severity-first score of the secrets that ``scan_secrets`` finds in them, by its two rules only."""
    scored = score.severity_scores(scan_secrets(spark, sf_dir), "file").select("file", "n_findings", "risk_score")
    return find.top_files(scored, 5)


def finding_snippets(spark, sf_dir):
    files = corpus.code_files(spark, sf_dir)
    found = _kept(spark, sf_dir).withColumn("line", F.col("line") + F.when(F.col("severity") == "INFO", 500).otherwise(0))
    return find.line_snippets(found, files).select("check_id", "file", "line", "source_line")


def finding_rows(spark, sf_dir):
    chunk = F.when(F.col("severity") == "ERROR", F.concat(F.lit("part_"), F.col("line").cast("string")))
    return _found(spark, sf_dir).select(
        "file", "line", "check_id",
        classify.finding_row(F.col("line"), F.col("severity"), F.col("message"), chunk, "  ").alias("row"),
        classify.chunk_row(F.col("line"), F.col("severity"), F.col("message")).alias("chunk_row"))


# files and lines ------------------------------------------------------------------

def line_counts(spark, sf_dir):
    return lines.line_counts(corpus.code_files(spark, sf_dir))


def language_map(spark, sf_dir):
    """Files of a mixed table, by extension; every other table name is no source file."""
    rows = corpus.code_files(spark, sf_dir).select(F.explode(F.array(
        F.col("path"), F.concat("path", F.lit(".TXT")), F.upper("path"),
        F.concat("path", F.lit(".d/.py")))).alias("path"), "content")
    files = file_source.files_from_table(rows, F.col("path"), F.col("content"))
    return files.groupBy(text.top_folder(F.col("path")).alias("folder"), "language").agg(
        F.count("*").alias("n_files"), F.max(text.base_name(F.col("path"))).alias("last_name"))


def pruned_paths(spark, sf_dir):
    """Paths a corpus scan keeps, when every document also lies in skipped folders."""
    rows = corpus.code_files(spark, sf_dir).select(F.explode(F.array(*[
        F.concat(F.lit(f"/repo/{folder}"), "path")
        for folder in ("", "dist/", "lib/.git/", "src/_gen/", "a/b/venv/", "targets/")])).alias("path"))
    return rows.where(file_source.kept_by_pruning(F.col("path"), "/repo")).dropDuplicates(["path"])


def line_windows(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir).select(
        F.concat("source", F.lit("/f"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return lines.line_windows(docs, 10).select("path", "chunk_id", "name", "start_line", "text")


def conversation_windows(spark, sf_dir):
    return lines.row_windows(_read(spark, sf_dir, "conversations"), "conv_id", F.col("turn").cast("int"),
                             F.col("text"), 3)


def group_overview(spark, sf_dir):
    """An entry for each document by its first line, which stands in for a summary in the query's SQL; later lines are not read."""
    return overview.entries(_doc_results(spark, sf_dir))


def group_totals(spark, sf_dir):
    """Documents with something in their first line, and their sources, as in the query's SQL; later lines are not read."""
    return overview.totals(_doc_results(spark, sf_dir))


def summary_cleanup(spark, sf_dir):
    opening = F.element_at(F.array(F.lit("summarize "), F.lit("Summary for a single "), F.lit("SUMMARY FOR "),
                                   F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    return _read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", summary.clean_summary(F.concat(opening, F.col("text"), F.lit(" "))).alias("summary"))


# chunks -----------------------------------------------------------------------------

def block_chunks(spark, sf_dir):
    return blocks.code_blocks(corpus.code_files(spark, sf_dir))


def chunk_bounds(spark, sf_dir):
    return blocks.chunk_bounds(corpus.code_files(spark, sf_dir), 10)


def segment_chunks(spark, sf_dir):
    """As chunk_bounds, with every file in pieces of a few lines that are folded apart and chained."""
    return segments.segment_chunks(segments.cut(corpus.code_files(spark, sf_dir), 8), 10)


def chunk_findings(spark, sf_dir):
    files = corpus.code_files(spark, sf_dir)
    return chunks.tag_findings(scan.scan(files), blocks.chunk_bounds(files, 10)).select(
        "check_id", "file", "line", "original_chunk", "chunk_id")


def chunk_remap(spark, sf_dir):
    """Scan chunk texts and address the findings in the original files."""
    files = corpus.code_files(spark, sf_dir)
    bounds = lines.line_windows(files, 4, "language")
    found = scan.scan(chunks.chunk_files(bounds))
    return chunks.remap_lines(found, bounds).select("check_id", "file", "line", "original_chunk", "chunk_id")


def chunk_rollup(spark, sf_dir):
    files = corpus.code_files(spark, sf_dir)
    bounds = _windows(spark, sf_dir).drop("text")
    scored = chunks.chunk_scores(chunks.tag_findings(scan.scan(files), bounds), bounds)
    return chunks.file_rollup(scored, (F.col("end_line") - F.col("start_line")) * 0.5).withColumn(
        "label", classify.risk_label(F.col("top_score")))


def narrative(spark, sf_dir):
    files = corpus.code_files(spark, sf_dir)
    # The first line of a chunk stands for its summary; the text itself goes no further.
    bounds = lines.line_windows(files, 4, "language").withColumn(
        "summary", summary.clean_summary(F.substring_index("text", "\n", 1))).drop("text")
    return chunks.narratives(chunks.chunk_scores(chunks.tag_findings(scan.scan(files), bounds), bounds))


# features ---------------------------------------------------------------------------

def call_features(spark, sf_dir):
    listed = lambda c: F.array_join(c, ",")
    return features.features(corpus.code_files(spark, sf_dir)).select(
        "path", "language", listed("sources").alias("sources"), listed("sinks").alias("sinks"))


def complexity(spark, sf_dir):
    return features.features(corpus.code_files(spark, sf_dir)).select("path", "complexity")


def feature_json(spark, sf_dir):
    return reports.feature_json(features.features(corpus.code_files(spark, sf_dir)))


def prompt_text(spark, sf_dir):
    files = corpus.code_files(spark, sf_dir)
    return audits.prompts(files, scan.scan(files), named=True)


# audits -----------------------------------------------------------------------------

def file_results(spark, sf_dir):
    files = corpus.code_files(spark, sf_dir)
    return audits.folder_audit(files, big_lines=20)["results"].select(
        "file", "language", "line_count", "big_file", "n_findings", "risk_score",
        F.array_join("sources", ",").alias("sources"), F.array_join("sinks", ",").alias("sinks"), "complexity", "summary")


def nested_results(spark, sf_dir):
    """The result set as JSON text, read back: one row per file with its findings inside."""
    audit = audits.folder_audit(corpus.code_files(spark, sf_dir), big_lines=20)
    raw = audits.nested_results(audit).select(F.to_json(F.struct("*")).alias("raw"))
    return reports.parse_results(raw).select(
        "file", "language", "line_count", "big_file", "risk_score", "summary",
        F.array_join("features.sources", ",").alias("sources"), "features.complexity",
        F.array_join(F.transform("findings", lambda f: F.concat(f["check_id"], F.lit(":"), f["line"].cast("string"))), ","
                     ).alias("findings"))


def folder_listing(spark, sf_dir):
    """The corpus written as a tree of files and read back: with pruning, without, and one level only."""
    number = F.regexp_extract("path", r"/f(\d+)\.", 1).cast("long")
    place = F.element_at(F.array(F.lit(""), F.lit("dist/"), F.lit("src/")), (number % 3 + 1).cast("int"))
    files = corpus.code_files(spark, sf_dir).select(
        F.when(number % 7 == 0, text.base_name(F.col("path"))).otherwise(F.concat(place, "path")).alias("path"), "content")
    root = f"{session.Run(spark).folder}/tree".removeprefix("file://").replace("file:/", "/")
    file_source.write_shared_folder(files, root)
    read = {"pruned": file_source.read_shared_folder(spark, root).drop("error"),
            "all": file_source.read_folder(spark, root, prune=False),
            "flat": file_source.read_shared_folder(spark, root, recursive=False).drop("error")}
    listed = [rows.select(F.lit(mode).alias("mode"), text.relative_path(F.col("path"), root).alias("path"), "language",
                          F.char_length("content").alias("n_chars")) for mode, rows in read.items()]
    return listed[0].unionByName(listed[1]).unionByName(listed[2])


def byte_files(spark, sf_dir):
    """Files as bytes, some of them broken: invalid bytes are dropped, files without bytes keep an error."""
    files = corpus.code_files(spark, sf_dir)
    number = F.regexp_extract("path", r"/f(\d+)\.", 1).cast("long")
    broken = F.concat(F.lit(b"\xff\xc3"), F.col("content").cast("binary"), F.lit(b"\x80"))
    raw = files.select("path", F.when(number % 5 != 0, F.when(number % 2 == 0, broken).otherwise(
        F.col("content").cast("binary"))).alias("raw"), F.when(number % 5 == 0, F.lit("no such file")).alias("error"))
    decoded = file_source.decoded_files(raw)
    readable = file_source.good(decoded)
    return scan.scan(readable).groupBy(F.col("file").alias("path")).agg(F.count("*").alias("n_findings")).join(
        decoded.select("path", F.char_length("content").alias("n_chars"), "error"), "path", "right")


def chunk_order(spark, sf_dir):
    """Chunks of every file with what is known of each, in order."""
    chunks_ = audits.large_file_audit(corpus.code_files(spark, sf_dir), size=10)["chunks"]
    return chunks_.select(
        "path", "chunk_id", "name", "start_line", "end_line", "n_findings", "risk_score", "complexity",
        F.array_join("sinks", ",").alias("sinks"),
        F.coalesce(F.array_join(F.transform("findings", lambda f: f["line"].cast("string")), ","), F.lit("")).alias("lines"))


def chunk_text(spark, sf_dir):
    """Texts of chunks: blocks, or windows of ten lines."""
    return blocks.chunk_texts(corpus.code_files(spark, sf_dir), 10).select("path", "chunk_id", "text")


def merged_results(spark, sf_dir):
    """As file_results, but another scanner's findings come first."""
    files = corpus.code_files(spark, sf_dir)
    audit = audits.folder_audit(files, primary=_primary(_kept(spark, sf_dir)), big_lines=20)
    return audit["results"].select("file", "big_file", "n_findings", "risk_score")


def project_map(spark, sf_dir):
    return audits.project_map(audits.folder_audit(
        corpus.code_files(spark, sf_dir), big_lines=20)).select(
        "section", "first", "second", "third", "text")


def large_file_findings(spark, sf_dir):
    return audits.large_file_audit(corpus.code_files(spark, sf_dir), size=10)["findings"].select(
        *FINDING, "original_chunk", "chunk_id")


def large_file_table(spark, sf_dir):
    """Rows of the findings table, each with its source line."""
    return audits.large_file_audit(corpus.code_files(spark, sf_dir), size=10)["table"].select(
        "file", "line", "rule_ord", "row")


def large_file_totals(spark, sf_dir):
    return audits.large_file_audit(corpus.code_files(spark, sf_dir), size=10)["totals"].select(
        "path", "n_chunks", "n_findings", "top_score", "n_risky", "label")


def single_file_results(spark, sf_dir):
    return audits.single_file_audit(corpus.code_files(spark, sf_dir))["files"].select(
        "path", "n_findings", "risk_score", "label", "complexity")


# samples ----------------------------------------------------------------------------

def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        "run_id", "n_samples", *[F.round(c, 6).alias(c) for c in (
            "wall_time_s", "cpu_time_s", "peak_memory_mb", "avg_cpu_percent", "estimated_energy_j",
            "estimated_carbon_gco2")], "rapl_supported")


def metric_rollup(spark, sf_dir):
    return _rounded(metrics.run_reports(_readings(spark, sf_dir)))


def modelled_energy(spark, sf_dir):
    """Runs without a hardware counter: energy from load and time."""
    plain = _readings(spark, sf_dir).withColumn("rapl_energy_uj", F.lit(None).cast("long"))
    return _rounded(metrics.run_reports(plain))


def counter_delta(spark, sf_dir):
    return metrics.counter_deltas(_readings(spark, sf_dir))


def counter_totals(spark, sf_dir):
    hourly = _readings(spark, sf_dir).withColumn("hour", F.floor(F.col("at_us") / 3_600_000_000))
    return metrics.counter_totals(hourly, "run_id", "hour")


def phase_durations(spark, sf_dir):
    return metrics.phase_shares(metrics.phase_durations(_marks(spark, sf_dir))).withColumns({
        "seconds": F.round("seconds", 6), "longest_share": F.round("longest_share", 6)})


def elapsed_series(spark, sf_dir):
    return metrics.elapsed_series(_readings(spark, sf_dir)).select("run_id", "sample_id", "elapsed_s")


def scalability_points(spark, sf_dir):
    points = metrics.scalability_points(metrics.run_reports(_readings(spark, sf_dir)))
    return points.select("run_id", "n_samples", F.round("avg_cpu_percent", 6).alias("avg_cpu_percent"),
                         F.round("peak_memory_mb", 6).alias("peak_memory_mb"))


def report_validity(spark, sf_dir):
    """Reports written as JSON, some without a wall time, read back."""
    rolled = metrics.run_reports(_readings(spark, sf_dir))
    wall = F.when(F.col("n_samples") > 66, F.col("wall_time_s")).alias("wall_time_s")
    raw = rolled.select(F.to_json(F.struct(
        wall, F.col("peak_memory_mb"), F.col("rapl_supported"),
        F.create_map(F.lit("scan"), F.col("wall_time_s")).alias("phase_timings"))).alias("raw"))
    return reports.parse_reports(raw).select(
        F.round("wall_time_s", 6).alias("wall_time_s"), F.round("peak_memory_mb", 6).alias("peak_memory_mb"),
        "rapl_supported", F.round(F.col("phase_timings")["scan"], 6).alias("scan_s"))


def stream_rollup(spark, sf_dir):
    events = rollup.events_stream(spark, sf_dir, _read(spark, sf_dir, "events").schema, "events.parquet")
    return _rounded(rollup.run_available(spark, rollup.readings_from_events(events)))


def all_queries() -> dict:
    named = [
        scan_secrets, scan_all_rules, scan_rule_file, scan_rule_table, scan_many_rules, pattern_and_not, scan_html_lines,
        rule_coverage, sequence_rules, call_rules, fallback_when_empty, json_findings, bulk_json_findings,
        classify_messages, classify_lines, category_join, dedup_findings, new_findings,
        risk_severity_first, risk_density, severity_counts, dashboard_counts, category_counts, top_categories,
        cross_file_rules, top_risky_files, top_secret_documents, finding_snippets, finding_rows,
        line_counts, language_map, pruned_paths, line_windows, conversation_windows,
        group_overview, group_totals, summary_cleanup,
        block_chunks, chunk_bounds, segment_chunks, chunk_findings, chunk_remap, chunk_rollup, narrative,
        call_features, complexity, feature_json, prompt_text,
        file_results, nested_results, byte_files, folder_listing, merged_results, chunk_order, chunk_text, project_map, large_file_findings, large_file_table, large_file_totals, single_file_results,
        metric_rollup, modelled_energy, counter_delta, counter_totals, phase_durations, elapsed_series,
        scalability_points, report_validity, stream_rollup,
    ]
    return {query.__name__: query for query in named}
