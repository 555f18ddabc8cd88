import pytest
from pyspark.sql import functions as F

from siftlines.functions import summary, text

@pytest.mark.parametrize("content", [
    "", "\n", "a", "a\n", "a\n\n", "a\nb", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1ee\x85f g h", "\r", "a\r\n", "é\n\nü"])
def test_lines_and_counts(one, content):
    translated = content.replace("\r\n", "\n").replace("\r", "\n")
    assert one(text.split_lines(F.col("c")), c=content) == translated.splitlines()
    reader = translated.split("\n")[:-1] if translated.endswith("\n") else (translated.split("\n") if translated else [])
    assert one(text.read_lines(F.col("c")), c=content) == reader
    assert one(text.newline_count(F.col("c")), c=content) == translated.count("\n") + 1
    assert one(text.reader_line_count(F.col("c")), c=content) == len(reader)


def test_unreadable_file_counts_as_a_hundred_lines(one):
    assert one(text.reader_line_count(F.col("c")), c=None) == 100


@pytest.mark.parametrize("value", ["  a b\t", "　x\xa0", "\x1f\x85y \n", "", "  "])
def test_strip(one, value):
    assert one(text.strip(F.col("c")), c=value) == value.strip()


def test_truncate(one):
    assert one(text.truncate(F.col("c"), 60), c="x" * 60) == "x" * 60
    assert one(text.truncate(F.col("c"), 60), c="x" * 61) == "x" * 57 + "..."


@pytest.mark.parametrize("path, language", [
    ("a/b.py", "python"), ("B.PY", "python"), ("x.min.js", "javascript"), ("y.c", "c"), ("Z.Java", "java"),
    ("a.cpp", None), (".py", None), ("d/.js", None), ("a..c", "c"), ("py", None), ("d.py/readme", None)])
def test_language(one, path, language):
    assert one(text.language_of(F.col("c")), c=path) == language


def test_paths(one):
    assert one(text.top_folder(F.col("c")), c="a.py") == "root"
    assert one(text.top_folder(F.col("c")), c="src\\x\\a.py") == "src"
    assert one(text.base_name(F.col("c")), c="src/x/a.py") == "a.py"
    assert one(text.relative_path(F.col("c"), "/r"), c="/r/a/b.py") == "a/b.py"


def test_invalid_bytes_are_dropped(spark):
    row = spark.createDataFrame([(bytearray(b"a\xffb\xc3\xa9\xc3"),)], "raw binary")
    assert row.select(text.make_text(F.col("raw")).alias("t")).collect()[0].t == "abé"


@pytest.mark.parametrize("raw, clean", [
    ("summarize the file ", "Handles the file."), ("Summary for a single thing.", "Implements logic for a single thing."),
    ("summary for  all", "Provides logic for all."), ("reads data.", "Reads data."), ("  ", ""), ("é", "É.")])
def test_clean_summary(one, raw, clean):
    assert one(summary.clean_summary(F.col("c")), c=raw) == clean


def test_prompt(spark):
    df = spark.createDataFrame(
        [(["ERROR - m (line 2)"], ["open", "input", "open"], [], 3, "x" * 500), ([], ["open"], ["eval"], 1, "y" * 500)],
        "notes array<string>, sources array<string>, sinks array<string>, complexity int, code string")
    first, second = [r.p for r in df.select(summary.prompt(
        F.col("notes"), F.col("sources"), F.col("sinks"), F.col("complexity"), F.col("code")).alias("p")).collect()]
    assert first == ("/* sinks=none | sources=input, open | complexity=3 | security_findings=ERROR - m (line 2) */\n"
                     + "x" * 450)
    assert second == "y" * 450
