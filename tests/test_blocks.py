import pytest
from pyspark.sql import functions as F

from siftlines.operators import blocks, chunks, lines, scan


def ranges(df):
    return [(r.name, r.start_line, r.end_line) for r in df.orderBy("path", "chunk_id").collect()]


def test_python_blocks(files):
    code = files(("a.py", "\n".join([
        "import os", "", "@one", "@two(a,", "  b)", "def f(x):", "    '''doc", "def not_this(): pass", "'''", "    return 1", "",
        "class A:", "    def m(self):", "        pass", "# note", "x = 1", "async def g(", "    a,", "):", "    pass", "",
        "def h(): pass", "def i(): pass", "if x:", "    def j(): pass"])))
    assert ranges(blocks.code_blocks(code)) == [
        ("f", 2, 10), ("A", 11, 14), ("g", 16, 20), ("h", 21, 22), ("i", 22, 23)]


def test_javascript_blocks(files):
    code = files(("a.js", "\n".join([
        "const a = 1;", "function f(x) {", "  function inner() { return '}'; }", "  // }", "  return `}", "}`;", "}",
        "async function g() { return 1; }", "class A extends B", "{", "  m() { }", "}", "export function no() {", "}",
        "app.get('/a', (req, res) => {", "  res.send('{');", "});", "router.post(`/b`, h);", "app.listen(1);",
        "app.use(cors());", "(function () {", "  function no() {}", "})();"])))
    assert ranges(blocks.code_blocks(code)) == [
        ("f", 1, 7), ("g", 7, 8), ("A", 8, 12), ("route_get_/a", 14, 17), ("route_post_`/b`", 17, 18),
        ("route_use_cors()", 19, 20)]


def test_java_blocks(files):
    code = files(("a.java", "\n".join([
        "package p;", "class A {", "  int x = f(1);", "  A() { x = 1; }", "  @Override", "  @Named(\"a\")",
        "  public static <T> List<T> all(T a,", "      int b) throws E {", "    if (a) { go(); } else { stop(); }",
        "    Runnable r = new Runnable() {", "      public void run() { }", "    };", "  }", "  abstract int size();",
        "  /* void no() { */", "  class B { ", "    int two() { return 2; }", "  }", "}"])))
    assert ranges(blocks.code_blocks(code)) == [("all", 4, 13), ("size", 13, 14), ("two", 16, 17)]


def test_chunks_fall_back_to_windows(files):
    code = files(("a.c", "\n".join("int x;" for _ in range(130))), ("b.py", "x = 1\n" * 61), ("c.py", "def f():\n  pass\nx = 1"),
                 ("d.js", ""))
    got = {(r.path, r.chunk_id, r.name, r.start_line, r.end_line) for r in blocks.chunk_bounds(code).collect()}
    assert got == {("a.c", 0, "lines_1_to_60", 0, 60), ("a.c", 1, "lines_61_to_120", 60, 120),
                   ("a.c", 2, "lines_121_to_130", 120, 130), ("b.py", 0, "lines_1_to_60", 0, 60),
                   ("b.py", 1, "lines_61_to_61", 60, 61), ("c.py", 0, "f", 0, 2)}
    windows = {(r.path, r.chunk_id, r.name, r.start_line, r.end_line)
               for r in lines.line_windows(code.where("path in ('a.c', 'b.py')")).collect()}
    assert windows == {g for g in got if g[0] != "c.py"}


def test_chunk_texts_and_gaps(files):
    code = files(("c.py", "a = 1\ndef f():\n  pass\n\nx = 1\n"))
    assert [r.text for r in blocks.chunk_texts(code).collect()] == ["def f():\n  pass"]
    assert [(r.start_line, r.end_line) for r in blocks.gaps(code).orderBy("start_line").collect()] == [(0, 1), (3, 5)]
    assert blocks.gaps(files(("a.c", "int x;"))).count() == 0


def test_long_file_is_one_linear_pass(files):
    body = "\n".join(f"def f{i}(a):\n    return a\n" for i in range(3000))
    assert blocks.code_blocks(files(("big.py", body))).count() == 3000


def test_scanning_chunks_equals_tagging_the_file(files):
    code = files(("a.py", "eval(a)\ndef f():\n  eval(b)\n  os.system(c)\n\ndef g(): eval(d)\nprint(x)"),
                 ("b.c", "\n".join(["gets(b);", "int x;"] * 100)))
    bounds = blocks.chunk_bounds(code)
    key = ["check_id", "file", "line", "original_chunk", "chunk_id", "snippet"]
    tagged = chunks.tag_findings(scan.scan(code), bounds, bucket=8).select(*key)
    remapped = chunks.remap_lines(scan.scan(chunks.chunk_files(blocks.chunk_texts(code))), bounds).select(*key)
    assert sorted(map(tuple, tagged.collect())) == sorted(map(tuple, remapped.collect()))
    assert tagged.where("file = 'a.py'").count() == 3 and tagged.where("file = 'b.c'").count() == 100


def test_chunk_scores_rollup_and_narrative(files, spark):
    code = files(("a.py", "def f():\n  eval(b)\n\ndef g():\n  print(d)\n\ndef h():\n  pass"))
    bounds = blocks.chunk_bounds(code)
    scored = chunks.chunk_scores(chunks.tag_findings(scan.scan(code), bounds), bounds)
    assert [(r.name, r.n_findings, r.risk_score) for r in scored.orderBy("chunk_id").collect()] == [
        ("f", 1, 7.0), ("g", 1, 1.0), ("h", 0, 0.0)]
    row = chunks.file_rollup(scored, F.lit(0.5)).collect()[0]
    assert (row.n_chunks, row.n_findings, row.top_score, row.n_risky, row.total_seconds) == (3, 2, 7.0, 1, 1.5)
    texts = spark.createDataFrame([(0, "Checks security of x.."), (1, " Prints\nd. "), (2, "Summary unavailable.")],
                                  "chunk_id int, summary string")
    told = chunks.narratives(scored.withColumn("language", F.lit("python")).join(texts, "chunk_id")).collect()[0]
    assert told.narrative == (
        "This module implements functional logic in python. During the chunked analysis, the file was partitioned into 3 "
        "logical components. A total of 2 security vulnerabilities were detected. Urgent security attention is required in "
        "the more vulnerable segments: f. Functionally, the key behaviors and responsibilities encapsulated by this code "
        "include: Prints d.")
    assert told.module_prompt == ("// Language: python\n// Implements the following features: Checks security of x; Prints d."
                                  "\nfunction get_module_features() {}\n")


def test_narrative_without_findings_or_summaries(spark):
    rows = spark.createDataFrame([("a", "c", 0, "x", "", 0.0, 0)],
                                 "path string, language string, chunk_id int, name string, summary string, "
                                 "risk_score double, n_findings long")
    told = chunks.narratives(rows).collect()[0]
    assert told.narrative.endswith("with no vulnerabilities detected across its components.")
    assert told.module_prompt == "// Language: c\n// General application module.\nfunction execute_module() {}\n"
    only = rows.withColumn("summary", F.lit("A security check.")).withColumn("n_findings", F.lit(1))
    assert chunks.narratives(only).collect()[0].narrative.endswith(
        "spread across the file. Functionally, the key behaviors and responsibilities encapsulated by this code include: "
        "A security check.")


@pytest.mark.parametrize("mark", ["\x0b", "\x0c", "\x1c", "\x85", " ", "\r", "\r\n"])
def test_scan_blocks_and_texts_number_lines_alike(files, mark):
    code = files(("a.py", f"x = 1\ny = '{mark}'\ndef f():\n    eval(x)\n"), ("b.c", f"int a;{mark}gets(b);\n" * 9))
    found = scan.scan(code)
    bounds = blocks.chunk_bounds(code, 10)
    tagged = chunks.tag_findings(found, bounds)
    assert tagged.count() == found.count() == 10
    texts = blocks.chunk_texts(code, 10)
    again = chunks.remap_lines(scan.scan(chunks.chunk_files(texts)), texts)
    key = lambda rows: {(r.file, r.check_id, r.line, r.chunk_id) for r in rows.collect()}
    assert key(again) == key(tagged)


def test_masked_code_is_worked_out_once(spark, files):
    # One pass over the pieces for each language, not one for every mark that may end a line.
    plan = blocks.chunk_bounds(files(("a.py", "def f():\n    return 1")))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all") <= 8


def test_brackets_of_long_lines(spark):
    row = spark.createDataFrame([("a{({[é]})}{", 1)], "c string, n int").select(
        blocks._count(F.col("c"), "{([").alias("o"), blocks._count(F.col("c"), "})]").alias("z")).first()
    assert (row.o, row.z) == (5, 4)
