import math

import pytest
from pyspark.sql import functions as F

from siftlines.functions import classify, lookups
from siftlines.operators import findings as find, overview, score

SCHEMA = ("check_id string, file string, line int, message string, severity string, snippet string, rule_ord int")


@pytest.fixture
def found(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), SCHEMA)
    return build


def row(check="r", file="a", line=1, message="m", severity="ERROR", ord=0):
    return (check, file, line, message, severity, "", ord)


@pytest.mark.parametrize("cwe, label", list(lookups.WEAKNESS_CATEGORY.items()))
def test_category_of_every_weakness(one, cwe, label):
    message = f"sql [{cwe}] text"
    assert one(F.struct(classify.weakness_id(F.col("c")), classify.category(F.col("c"))), c=message) == (cwe, label)


def test_category_by_keyword_in_list_order(spark):
    rows = [(f"xx {word.upper()} yy",) for word, _ in lookups.KEYWORD_CATEGORY]
    got = [r.c for r in spark.createDataFrame(rows, "m string").select(classify.category(F.col("m")).alias("c")).collect()]
    want = [next(label for word, label in lookups.KEYWORD_CATEGORY if word in text.lower()) for (text,) in rows]
    assert got == want


@pytest.mark.parametrize("message, weakness, label", [
    (None, "N/A", "Other"), ("", "N/A", "Other"), ("hello", "N/A", "Other"),
    ("[CWE-415] Double free", "CWE-415", "Other"), ("[CVE-2021-44228] x", "CVE-2021-44228", "Known CVE"),
    ("[CWE-] sql", "N/A", "SQL Injection")])
def test_other_messages(one, message, weakness, label):
    assert one(F.struct(classify.weakness_id(F.col("c")), classify.category(F.col("c"))), c=message) == (weakness, label)


@pytest.mark.parametrize("raw, shown, panel", [
    ("error", "HIGH", "HIGH"), ("Warning", "MEDIUM", "MEDIUM"), ("INFO", "LOW", "LOW"), ("low", "LOW", "LOW"),
    ("critical", "CRITICAL", "LOW"), (None, "LOW", "LOW")])
def test_severity_words(one, raw, shown, panel):
    assert one(classify.display_severity(F.col("c")), c=raw) == shown
    assert one(classify.dashboard_severity(F.col("c")), c=raw) == panel


@pytest.mark.parametrize("value, label, panel, gauge", [
    (10.0, "CRITICAL", "HIGH", 100), (8.0, "CRITICAL", "HIGH", 80), (7.9, "HIGH", "MEDIUM", 79), (5.0, "HIGH", "MEDIUM", 50),
    (4.9, "MEDIUM", "LOW", 49), (2.0, "MEDIUM", "LOW", 20), (1.9, "LOW", "LOW", 19), (0.0, "LOW", "LOW", 0)])
def test_bands(one, value, label, panel, gauge):
    got = one(F.struct(classify.risk_label(F.lit(value)), classify.panel_label(F.lit(value)),
                       classify.gauge_percent(F.lit(value))))
    assert got == (label, panel, int(value / 10.0 * 100))


@pytest.mark.parametrize("severities, want", [
    (["ERROR"], 7.0), (["ERROR", "ERROR"], 8.0), (["ERROR", "WARNING"], 7.5), (["WARNING"], 4.0),
    (["WARNING", "WARNING"], 4.5), (["INFO"], 1.0), (["INFO", "ERROR", "WARNING"], 7.6),
    (["odd"], 1.0), (["error"] * 9, 10.0), (["INFO"] * 4, 1.3)])
def test_severity_first_score(found, severities, want):
    rows = [row(line=i, severity=s) for i, s in enumerate(severities)]
    assert score.severity_scores(found(*rows), "file").collect()[0].risk_score == want


def test_no_findings_score_zero(one, files, found):
    assert one(score.severity_score(F.lit(0), F.lit(0), F.lit(0))) == 0.0
    got = score.density_scores(found(row()).where("false"), files(("a.py", "x"))).collect()[0]
    assert (got.risk_score, got.n_findings) == (0.0, 0)


def test_density_score(files, found):
    code = files(("a.py", "\n".join(["x"] * 5000)), ("b.py", "x"))
    got = {r.file: r.risk_score for r in score.density_scores(
        found(row(file="a.py"), row(file="a.py", severity="INFO"), row(file="b.py", severity="critical")), code).collect()}
    assert got == {"a.py": round(3.5 / math.log(5000) * 5, 1), "b.py": round(0.5 / math.log(2) * 5, 1)}


def test_first_of_equal_findings_is_kept(found):
    rows = [row("z", ord=0), row("a", ord=1), row("b", line=2, ord=2), row("c", message="other", ord=3)]
    kept = find.distinct_findings(found(*rows), "rule_ord")
    assert sorted(r.check_id for r in kept.collect()) == ["b", "c", "z"]


def test_new_findings_compare_whole_records(found):
    a, b = row("a"), row("b")
    assert [r.check_id for r in find.new_findings(found(a, b), found(a)).collect()] == ["b"]
    tagged = found(a).withColumn("chunk_id", F.lit(1))
    assert find.new_findings(tagged, found(a)).count() == 0


def test_categories_rank_ties_by_first_appearance(found):
    rows = [row(file="b", message="[CWE-79] x"), row(file="a", message="[CWE-89] x", ord=5),
            row(file="a", message="[CWE-78] x", ord=2), row(file="c", message="[CWE-78] x")]
    got = [(r["rank"], r.category, r.n_findings) for r in find.category_counts(found(*rows)).collect()]
    assert got == [(1, "Command Injection", 2), (2, "SQL Injection", 1), (3, "XSS", 1)]
    assert find.category_counts(found(*rows), 2).count() == 2


def test_cross_file_rules(found):
    rows = [row("r1", "a"), row("r1", "a", 2), row("r1", "b"), row("r2", "a"), row("r3", "a"), row("r3", "b"), row("r3", "c")]
    got = {(r.check_id, r.file, r.n_files) for r in find.cross_file_rules(found(*rows)).collect()}
    assert got == {("r1", "a", 2), ("r1", "b", 2), ("r3", "a", 3), ("r3", "b", 3), ("r3", "c", 3)}
    assert {r.check_id for r in find.cross_file_rules(found(*rows), 1).collect()} == {"r3"}


def test_dashboard_and_severity_counts(found):
    df = found(row(), row(severity="WARNING"), row(severity="odd"), row(severity="INFO"))
    assert find.dashboard_counts(df).collect()[0] == (1, 1, 2, 4)
    assert {r.severity: r.n_findings for r in find.severity_counts(df).collect()} == {
        "HIGH": 1, "MEDIUM": 1, "ODD": 1, "LOW": 1}


def test_line_snippets(files, found):
    code = files(("a", "one\n  two " + "x" * 200 + "\nthree"))
    got = {r.line: r.source_line for r in find.line_snippets(
        found(row(line=2), row(line=0), row(line=4), row(line=3), row(line=2, check="q")), code).collect()}
    assert got == {0: "", 2: "two " + "x" * 96, 3: "three", 4: ""}


def test_only_lines_with_findings_leave_their_files(files, found):
    code = files(*[(f"f{i}", "\n".join(f"line {j}" for j in range(500))) for i in range(20)])
    pointed = found(*[row(file=f"f{i}", line=7 * i + 1) for i in range(0, 20, 2)])
    kept = find.wanted_lines(pointed, code)
    assert 10 <= kept.count() <= 12  # of 10,000
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_finding_row(one):
    got = one(classify.finding_row(F.lit(17), F.lit("ERROR"), F.lit("[CWE-89] " + "y" * 70), F.lit("go"), "  "))
    cwe = " (CWE-89)"
    assert got == f"  Line   17  [HIGH  ]  SQL Injection{cwe:<24s} — {'y' * 57}...  (chunk: go)"


def test_chunk_row_and_severity_totals(one, found):
    got = one(classify.chunk_row(F.lit(3), F.lit("INFO"), F.lit("[CWE-532] " + "y" * 70)))
    assert got == "[LOW] Line 3 -- Info Exposure (Logs) (CWE-532): [CWE-532] " + "y" * 60
    df = found(row(), row(severity="WARNING"), row(severity="odd"), row(severity="INFO"))
    assert find.severity_totals(df).collect()[0] == (1, 1, 1, 4)


def test_overview(spark):
    results = spark.createDataFrame(
        [("a.py", "One."), ("src/b.py", "x" * 90), ("src/c.py", "  "), ("src/d/e.py", None), ("src/d/f.py", "Two.")],
        "file string, summary string")
    got = {(r.group, r.entry, r.n_files) for r in overview.entries(results).collect()}
    assert got == {("root", "a.py — One.", 1), ("src", "b.py — " + "x" * 62 + "...", 2), ("src", "f.py — Two.", 2)}
    assert overview.totals(results).collect()[0] == (3, 2)


def test_scores_by_join_keep_category(found):
    got = find.categories_by_join(found(row(message="[CWE-89] x"), row(message="[CWE-16] x"))).select("category").collect()
    assert sorted(r.category for r in got) == ["Other", "SQL Injection"]
