import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlines.functions import text
from siftlines.operators import features, findings as find
from siftlines.sources import files as file_source, reports, scanner_json


@pytest.fixture
def tree(tmp_path):
    content = {"a.py": b"x = 1\n", "B.PY": b"y\xff = 2", "n.txt": b"no", "__init__.py": b"", "src/_c.c": b"int x;",
               "src/.hid.js": b"1", "node_modules/m.js": b"2", ".git/h.py": b"3", "src/build/x.java": b"4", "_gen/d.java": b"5"}
    for name, body in content.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    os.symlink(tmp_path / "a.py", tmp_path / "src" / "link.py")
    return str(tmp_path)


def names(df, root):
    return sorted(os.path.relpath(r.path, os.path.realpath(root)) for r in df.select("path").collect())


def test_shared_folder_reads_hidden_names(spark, tree):
    got = file_source.read_shared_folder(spark, tree)
    assert names(got, tree) == ["B.PY", "__init__.py", "_gen/d.java", "a.py", "src/.hid.js", "src/_c.c"]
    rows = {os.path.basename(r.path): (r.content, r.language, r.error) for r in got.collect()}
    assert rows["B.PY"] == ("y = 2", "python", None) and rows["__init__.py"] == ("", "python", None)


def test_shared_folder_plain_and_flat(spark, tree):
    plain = file_source.read_shared_folder(spark, tree, prune=False)
    assert names(plain, tree) == [".git/h.py", "B.PY", "__init__.py", "_gen/d.java", "a.py", "node_modules/m.js",
                                  "src/.hid.js", "src/_c.c", "src/build/x.java"]
    assert names(file_source.read_shared_folder(spark, tree, recursive=False), tree) == ["B.PY", "__init__.py", "a.py"]


def test_unreadable_file_keeps_its_error(spark, tree):
    os.symlink(os.path.join(tree, "gone"), os.path.join(tree, "z.py"))
    got = file_source.read_shared_folder(spark, tree)
    bad = file_source.errored(got).collect()
    assert len(bad) == 1 and "No such file" in bad[0].error
    assert file_source.good(got).count() == 6


def test_any_file_system_reader(spark, tree):
    got = file_source.read_folder(spark, tree)
    assert names(got, tree) == ["B.PY", "a.py", "src/link.py"]
    assert names(file_source.read_folder(spark, tree, recursive=False), tree) == ["B.PY", "a.py"]
    assert "node_modules/m.js" in names(file_source.read_folder(spark, tree, prune=False), tree)


def test_files_from_table(spark):
    rows = spark.createDataFrame([("a.py", "x"), ("b.md", "y")], "name string, body string")
    assert file_source.files_from_table(rows, F.col("name"), F.col("body")).collect() == [("a.py", "x", "python")]
    assert file_source.files_from_table(rows, F.col("name"), F.col("body"), F.lit("c")).count() == 2


OUTPUT = {"results": [
    {"check_id": "r1", "path": "./src/a.py", "start": {"line": 3}, "extra": {"message": "m", "severity": "error", "lines": "\t x \n"}},
    {"check_id": "r2", "path": "/b.py", "extra": {}}]}


def test_scanner_output(spark):
    raws = [("log\n" + json.dumps(OUTPUT) + "\nend",), ("no json",), ("{broken",), ("{}",), (None,)]
    df = spark.createDataFrame(raws, "raw string")
    assert [tuple(r) for r in scanner_json.findings(df).collect()] == [
        ("r1", "./src/a.py", 3, "m", "ERROR", "x", 0), ("r2", "/b.py", None, None, "INFO", "", 1)]
    assert [tuple(r) for r in scanner_json.bulk_findings(df, "/repo").collect()] == [
        ("r1", "/repo/src/a.py", 3, "m", "ERROR", "x", 0), ("r2", "/b.py", 0, "", "INFO", "", 1)]


def test_files_join_bulk_findings(files, spark):
    df = spark.createDataFrame([(json.dumps(OUTPUT),)], "raw string")
    joined = find.files_with_findings(files(("/b.py", ""), ("/c.py", "")), scanner_json.bulk_findings(df))
    assert {(r.file, r.check_id) for r in joined.collect()} == {("/b.py", "r2"), ("/c.py", None)}


def test_results_and_reports(spark, tmp_path):
    results = tmp_path / "results.json"
    results.write_text(json.dumps([
        {"file": "a", "language": "c", "risk_score": 1.5, "findings": [], "features": {"sources": ["gets"], "sinks": [],
         "complexity": 1}, "summary": "S."}, {"file": "b", "error": "gone"}]))
    got = {r.file: r for r in reports.read_results(spark, str(results)).collect()}
    assert got["a"].features.sources == ["gets"] and got["a"].line_count is None and got["b"].error == "gone"
    folder = tmp_path / "reports"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps({"wall_time_s": 2.0, "phase_timings": {"scan": 1.5}, "readings": [
        {"timestamp": 1.0, "cpu_percent": 2.0, "memory_mb": 3.0, "rapl_energy_uj": None}]}))
    (folder / "two.json").write_text(json.dumps({"peak_memory_mb": 1.0}))
    read = reports.read_reports(spark, str(folder)).collect()
    assert len(read) == 1 and read[0].phase_timings == {"scan": 1.5} and read[0].readings[0].memory_mb == 3.0
    raw = spark.createDataFrame([('{"wall_time_s": 1}',), ("{}",), ("x",)], "raw string")
    assert reports.parse_reports(raw).count() == 1


def test_sinks(spark, files, tmp_path):
    described = features.features(files(("a.py", "eval(x)")))
    reports.write_features(described, str(tmp_path / "f"))
    assert [r.value for r in spark.read.text(str(tmp_path / "f")).collect()] == [
        'a.py\t{"sources":[],"sinks":["eval"],"complexity":0}']
    reports.write_json(described, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    text = spark.createDataFrame([(i, f"line {i}") for i in range(100)], "n int, text string").orderBy("n")
    reports.write_text(text, str(tmp_path / "t"))
    parts = sorted(p for p in os.listdir(tmp_path / "t") if p.startswith("part-"))
    assert "".join((tmp_path / "t" / p).read_text() for p in parts).splitlines() == [f"line {i}" for i in range(100)]


@pytest.mark.parametrize("path, normal", [
    ("./p/../a.py", "/repo/a.py"), ("/x//y/./z.py", "/x/y/z.py"), ("../../a.py", "/a.py"), ("a/b/../../c.py", "/repo/c.py")])
def test_bulk_paths_are_resolved(spark, path, normal):
    raw = spark.createDataFrame([(json.dumps({"results": [{"check_id": "r", "path": path}]}),)], "raw string")
    assert scanner_json.bulk_findings(raw, "/repo").collect()[0].file == normal


def test_results_one_a_line_keep_their_order(spark, tmp_path):
    (tmp_path / "out.jsonl").write_text("\n".join(
        json.dumps({"check_id": f"r{i}", "path": "a.py", "start": {"line": 9 - i}, "extra": {"message": "m"}}) for i in range(5)))
    found = scanner_json.findings(scanner_json.read_result_lines(spark, str(tmp_path / "out.jsonl")))
    assert [r.check_id for r in found.orderBy("rule_ord").collect()] == [f"r{i}" for i in range(5)]
    assert {r.rule_ord for r in found.collect()} == set(range(5))


def test_bytes_to_text(spark):
    raw = spark.createDataFrame([(b"a\xffb",), ("a�b".encode(),), ("�".encode() + b"\xc3",), (b"",), (None,)], "raw binary")
    assert [r.t for r in raw.select(text.make_text(F.col("raw")).alias("t")).collect()] == ["ab", "a�b", "�", "", None]


def test_tree_is_written_and_read(files, spark, tmp_path):
    code = files(("a.py", "x = 1\r\n"), ("d/b.c", "int é;"), ("node_modules/c.js", "1"))
    assert file_source.write_shared_folder(code, str(tmp_path)) == 3
    read = file_source.read_shared_folder(spark, str(tmp_path))
    assert {(r.path.removeprefix(f"{tmp_path}/"), r.content) for r in read.collect()} == {("a.py", "x = 1\r\n"), ("d/b.c", "int é;")}
    assert file_source.read_folder(spark, str(tmp_path), prune=False).count() == 3


def test_contents_never_move(files, spark, tmp_path):
    """No exchange holds a file's contents, its lines or a chunk's text."""
    from siftlines.operators import blocks, chunks, findings, lines, overview, scan
    from siftlines.plans import audits
    file_source.write_shared_folder(files(("a.py", "eval(x)")), str(tmp_path))
    code = file_source.read_folder(spark, str(tmp_path))
    found = scan.scan(code)
    bounds = blocks.chunk_bounds(code, 10, "language")
    plans = [code, found, findings.line_snippets(found, code), chunks.tag_findings(found, bounds),
             chunks.remap_lines(scan.scan(chunks.chunk_files(lines.line_windows(code, 4, "language"))), bounds),
             audits.prompts(code, found), audits.folder_audit(code)["results"], audits.large_file_audit(code)["chunks"]]
    for plan in plans:
        executed = plan._jdf.queryExecution().executedPlan()
        todo = [executed.inputPlan() if "AdaptiveSparkPlan" in executed.nodeName() else executed]
        while todo:
            node = todo.pop()
            if "Exchange" in node.nodeName():
                names = {node.output().apply(i).name() for i in range(node.output().size())}
                assert not {"content", "text", "pairs", "lines"} & names, names
            todo += [node.children().apply(i) for i in range(node.children().size())]


def test_many_small_files_are_read_in_batches_by_all_tasks(files, spark, tmp_path):
    code = files(*[(f"d{i % 3}/f{i}.py", f"x = {i}") for i in range(600)])
    assert file_source.write_shared_folder(code, str(tmp_path)) == 600
    (tmp_path / "d0" / "link.py").symlink_to(tmp_path / "d1" / "f1.py")
    (tmp_path / "d0" / "lost.py").symlink_to(tmp_path / "none.py")
    read = file_source.read_shared_folder(spark, str(tmp_path))
    got = {r.path.removeprefix(f"{tmp_path}/"): (r.content, r.error is None) for r in read.collect()}
    assert got == {f"d{i % 3}/f{i}.py": (f"x = {i}", True) for i in range(600)} | {"d0/lost.py": (None, False)}
    counts = [n for n in read.rdd.glom().map(len).collect() if n]
    assert len(counts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(counts) == 601
    assert sum(1 for _ in file_source._read_contents([pa.RecordBatch.from_pydict({"path": [
        str(tmp_path / f"d{i % 3}" / f"f{i}.py") for i in range(600)]})])) == 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        whole = file_source.read_folder(spark, str(tmp_path))
        assert whole.rdd.getNumPartitions() <= 32 * spark.sparkContext.defaultParallelism
        assert whole.select("path").distinct().count() >= 600
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
