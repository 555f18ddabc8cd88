import math

from pyspark.sql import functions as F

from siftlines import session
from siftlines.plans import audits

BIG = "def f():\n  eval(a)\n" + "x = 1\n" * 250 + "os.system(c)\n"


def test_folder_audit(files, spark):
    code = files(("s/a.py", "eval(x)\nprint(y)"), ("s/b.py", BIG), ("c.js", "const z = 1;"), ("d.txt", "eval(x)"))
    code = code.withColumn("error", F.lit(None).cast("string")).unionByName(spark.createDataFrame(
        [("e.py", None, "python", "gone")], "path string, content string, language string, error string"))
    audit = audits.folder_audit(code)
    got = {r.file: r for r in audit["results"].collect()}
    assert set(got) == {"s/a.py", "s/b.py", "c.js"}
    assert (got["s/a.py"].n_findings, got["s/a.py"].risk_score) == (2, 10.0)
    assert got["s/a.py"].summary == "Summary unavailable." and not got["s/a.py"].big_file
    assert got["s/b.py"].big_file and got["s/b.py"].line_count == 254
    assert got["s/b.py"].risk_score == round(6 / math.log(253) * 5, 1)
    assert "partitioned into 1 logical components. A total of 1 security" in got["s/b.py"].summary
    assert got["c.js"].risk_score == 0.0
    assert [tuple(r) for r in audit["errors"].collect()] == [("e.py", "gone")]

    nested = {r.file: r for r in audits.nested_results(audit).collect()}
    assert [f.line for f in nested["s/a.py"].findings] == [1, 2] and nested["c.js"].findings == []
    assert nested["e.py"].error == "gone" and nested["s/a.py"].features.sinks == ["eval"]

    report = audits.project_map(audit).collect()
    lines = "\n".join(r.text for r in report).split("\n")
    after = lambda title, n: lines[lines.index(title) + 1:][:n]
    assert lines[:6] == ["=" * 65, "  PROJECT-LEVEL SECURITY MAP", "  Directory : ", "  Files     : 4", "=" * 65, ""]
    assert after("  PROJECT OVERVIEW", 6) == [
        "  " + "─" * 63, "Project contains 3 source file(s) across 2 component(s):", "", "  [root]  (1 file(s))",
        "    * c.js — Summary unavailable.", ""]
    assert after("  SECURITY STATS", 5) == [
        "  " + "─" * 63, "  Total Issues : 4", "    High Vulnerability   : 3", "    Medium Vulnerability : 0",
        "    Low Vulnerability    : 1"]
    assert after("  TOP RISKIEST FILES", 2)[1] == "  [CRITICAL] 10.0/10  s/a.py  (2 finding(s))"
    assert after("  MOST COMMON VULNERABILITY TYPES", 2)[1] == "  1. Code Injection               — 2 occurrence(s)"
    assert after("  CROSS-FILE VULNERABILITY PATTERNS", 4)[1:] == ["  fallback.py.code-eval", "     → s/a.py", "     → s/b.py"]
    assert after("  s/a.py  [CRITICAL  10.0/10]", 2) == ["  Summary unavailable.", "    Vulnerabilities (2):"]
    assert after("  FILES WITH ERRORS (skipped)", 4) == ["  e.py — gone", "", "=" * 65, ""]
    assert [r.section for r in report] == sorted(r.section for r in report)


def test_report_of_nothing(files, spark):
    bad = spark.createDataFrame([("e.py", None, "python", "gone")], "path string, content string, language string, error string")
    text = [r.text for r in audits.project_map(audits.folder_audit(bad)).collect()]
    assert text[1:4] == ["  Files     : 1", "=" * 65, "\n  [!] No files could be analyzed."]
    assert not any("Issues" in t for t in text)
    blank = spark.createDataFrame([("a.py", " ")], "path string, summary string")
    text = [r.text for r in audits.project_map(audits.folder_audit(files(("a.py", "x = 1")), summaries=blank)).collect()]
    assert "No summaries could be generated." in text


def test_building_an_audit_starts_no_job(files, spark):
    spark.sparkContext.setJobGroup("building", "")
    code = files(("a.py", BIG))
    audits.folder_audit(code, keep=session.lazily)
    audits.large_file_audit(code, keep=session.lazily)
    audits.single_file_audit(code, keep=session.lazily)
    started = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not started


def test_a_run_gives_the_same_and_leaves_nothing(files, spark, tmp_path):
    code = files(("s/a.py", "eval(x)\nprint(y)"), ("s/b.py", BIG))
    lazy = audits.folder_audit(code, keep=session.lazily)["results"].orderBy("file").collect()
    with session.Run(spark, str(tmp_path)) as run:
        assert audits.folder_audit(code, keep=run.keep)["results"].orderBy("file").collect() == lazy
        assert list(tmp_path.iterdir())
    assert not list(tmp_path.iterdir())


def test_openings(files, spark):
    told = spark.createDataFrame([("b.py", "Runs commands"), ("c.py", "It has vulnerabilities.")], "path string, opening string")
    code = files(("b.py", BIG), ("c.py", "x = 1\n" * 300))
    got = {r.path: r.narrative for r in audits.large_file_audit(code, openings=told)["narratives"].collect()}
    assert got["b.py"].startswith("Runs commands. During the chunked analysis")
    assert got["c.py"].startswith("This module provides core logic and functionality for the python application. During")


def test_primary_findings_come_first_and_chunks_add_to_big_files(files, spark):
    code = files(("a.py", "eval(x)"), ("b.py", BIG), ("c.py", "eval(x)"))
    primary = spark.createDataFrame(
        [("p", "a.py", 7, "own", "INFO", "", 0), ("p", "b.py", 8, "own", "WARNING", "", 0)],
        "check_id string, file string, line int, message string, severity string, snippet string, rule_ord int")
    found = audits.folder_audit(code, primary=primary)["findings"].collect()
    assert {(r.file, r.check_id, r.original_chunk) for r in found} == {
        ("a.py", "p", None), ("b.py", "p", None), ("b.py", "fallback.py.code-eval", "f"), ("c.py", "fallback.py.code-eval", None)}


def test_own_summaries_are_used(files, spark):
    code = files(("a.py", "x = 1"))
    told = spark.createDataFrame([("a.py", "Sets x.")], "path string, summary string")
    assert audits.folder_audit(code, summaries=told)["results"].collect()[0].summary == "Sets x."


def test_large_file_audit(files):
    audit = audits.large_file_audit(files(("b.py", BIG), ("c.c", "gets(a);\n" * 61)))
    assert [(r.path, r.name, r.n_findings) for r in audit["chunks"].collect()] == [
        ("b.py", "f", 1), ("c.c", "lines_1_to_60", 60), ("c.c", "lines_61_to_61", 1)]
    totals = {r.path: r for r in audit["totals"].collect()}
    assert (totals["c.c"].top_score, totals["c.c"].label, totals["c.c"].n_chunks) == (10.0, "CRITICAL", 2)
    assert [(r.category, r.n_findings) for r in audit["categories"].collect()] == [
        ("Buffer Overflow", 61), ("Code Injection", 1)]
    assert audit["narratives"].count() == 2
    assert [r.line for r in audit["findings"].where("file = 'c.c'").collect()] == list(range(1, 62))
    chunk = audit["chunks"].collect()[0]
    assert (chunk.sources, chunk.sinks, chunk.complexity) == ([], ["eval"], 0)
    assert [(f.line, f.original_chunk) for f in chunk.findings] == [(2, "f")]
    assert chunk.prompt.startswith("/* sinks=eval | sources=none") and chunk.prompt.endswith("def f():\n  eval(a)")
    assert audit["table"].collect()[0].row.split("\n")[1] == " " * 16 + "|-- eval(a)"
    twice = audits.large_file_audit(files(("d.py", "def f(): eval(a)\n")))["totals"].collect()
    assert [r.n_findings for r in twice] == [1]


def test_single_file_audit(files):
    audit = audits.single_file_audit(files(("d/a.py", "eval(input())\nprint(y)"), ("b.js", "let a = 1;")))
    got = {r.path: r for r in audit["files"].collect()}
    assert (got["d/a.py"].risk_score, got["d/a.py"].label, got["b.js"].risk_score) == (7.1, "HIGH", 0.0)
    prompts = {r.path: r.prompt for r in audit["prompts"].collect()}
    assert prompts["b.js"] == "let a = 1;"
    assert prompts["d/a.py"].startswith("/* sinks=eval | sources=input | complexity=0 | security_findings=ERROR - [CWE-94]")
    assert prompts["d/a.py"].endswith(" */\neval(input())\nprint(y)")
