"""Files in pieces give what files in one row give."""

import random

import pytest
from pyspark.sql import functions as F

from siftlines import session
from siftlines.operators import blocks, segments
from siftlines.sources import files as file_source

# Lines that open, close and hide brackets, blocks, strings and comments, and some that are broken.
LINES = {
    "py": ["def f(a):", "    return a", "class A:", "    def m(self):", '    """doc', 'def hidden(): pass', '"""', "'''", "x = '''a'''", "@one",
           "@two(a,", "  b)", "async def g(", "):", "x = 1  # note \"\"\"", "", "    pass", "s = \"it's\"", "'", '"', "\tif x:", 'y = """', "z\x0cw",
           "a\u2028b"],
    "js": ["function f(x) {", "}", "  if (a) {", "  }", "class A {", "const t = `a", "b ${c} {", "`;", "/* open", "close */", "// }", "app.get('/a', (q) => {",
           "});", "x = /[{]/;", "y = a / b;", "const s = '}';", "router.use(m);", "async function g() { return 1; }", "\\` `", "(", ")", "", "{", "a\x85b"],
    "java": ["class A {", "}", "  void go(int a) {", "  }", "  @Override", "  @Named(\"a\")", "  public String name()", "  {", "    if (a) { b(); } else { c(); }",
             "/* void no() {", "*/", "// }", "  int size();", "    Runnable r = new Runnable() {", "      public void run() { }", "    };", "",
             "  static <T> List<T> all(T a,", "      int b) throws E {", "}}", "{", "String s = \"}\";"],
    "c": ["int f(void) {", "}", "/* open", "close */", ""],
}


def made(n_files: int, seed: int) -> list[tuple[str, str]]:
    pick = random.Random(seed)
    out = []
    for i in range(n_files):
        kind = ("py", "js", "java", "c")[i % 4]
        lines = [pick.choice(LINES[kind]) for _ in range(pick.randint(0, 60))]
        out.append((f"d/f{i}.{kind}", pick.choice(["\n", "\n", "\r\n"]).join(lines) + pick.choice(["", "\n"])))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [2])
def test_pieces_give_the_blocks_of_the_whole(spark, files, size, tmp_path):
    code = files(*made(60, 5), ("empty.py", ""), ("one.js", "function f() {")).cache()
    with session.Run(spark, str(tmp_path)) as run:
        got = segments.segment_chunks(segments.cut(code, size), 7, keep=run.keep)
        assert rows(got) == rows(blocks.chunk_bounds(code, 7))


def test_a_block_through_many_pieces(files):
    body = "\n".join(f"  a{i}(); /* }} */" for i in range(90))
    code = files(("a.js", "class A {\n" + body + "\n}\nfunction b() {\n" + body),
                 ("b.java", "class A {\n void go() {\n" + body + "\n @X\n @Y\n }\n int two() { return 2; }\n}"),
                 ("c.py", "class A:\n" + "\n".join("    x = '''\ndef no(): pass\n'''" for _ in range(40))),
                 ("d.py", 'def a():\n    s = """' + "\n" * 50 + "def b():\n    pass\n"))
    got = segments.segment_blocks(segments.cut(code, 3))
    assert rows(got) == rows(blocks.code_blocks(code))


def test_rounds_do_not_grow_with_the_pieces_of_an_open_block(spark, files, tmp_path):
    code = files(("a.js", "class A {\n" + "  go();\n" * 400 + "}\n"))
    with session.Run(spark, str(tmp_path)) as run:
        assert segments.segment_blocks(segments.cut(code, 2), keep=run.keep).count() == 1
        assert run.tables < 20  # of 201 pieces


def test_byte_ranges_of_files_are_read_by_several_tasks(spark, tmp_path):
    root = tmp_path / "big"
    (root / "sub dir").mkdir(parents=True)
    for i, (path, content) in enumerate(made(4, 9)):
        kind = path.rsplit(".", 1)[1]
        pick = random.Random(i)
        lines = [pick.choice(LINES[kind]) for _ in range(300)]
        (root / "sub dir" / f"f+{i}.{kind}").write_text("\n".join(lines), encoding="utf-8", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pieces = file_source.read_segments(spark, str(root), most=120)
        assert pieces.rdd.getNumPartitions() > 30
        assert pieces.groupBy("path").count().where("count > 12").count() == 4
        with session.Run(spark, str(tmp_path / "run")) as run:
            held = run.keep(pieces)
            got = rows(segments.segment_blocks(held, keep=run.keep))
        whole = file_source.read_folder(spark, str(root))
        assert {r.path for r in whole.select("path").collect()} == {r.path for r in pieces.select("path").distinct().collect()}
        joined = pieces.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "content"))),
                                                                     lambda s: s["content"]), "").alias("content"))
        assert {(r.path, r.content.rstrip("\n")) for r in joined.collect()} == {
            (r.path, r.content.rstrip("\n")) for r in whole.collect()}
        assert got == rows(blocks.code_blocks(whole))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_files_are_chained_by_the_task_not_one_by_one(spark, files, tmp_path):
    code = files(*[(f"f{i}.py", "def f():\n    return 1\n\ndef g():\n    return 2") for i in range(400)])
    known = []

    def keep(df):
        plan = df._jdf.queryExecution().toString()
        assert "FlatMapGroupsInArrow" not in plan
        if "MapInArrow" in plan:
            # As many tasks as are set, however few bytes the states of the files have.
            known.append(df.rdd.getNumPartitions())
        return run.keep(df)

    with session.Run(spark, str(tmp_path)) as run:
        assert segments.segment_blocks(segments.cut(code, 2), keep=keep).count() == 800
    assert known and set(known) == {int(spark.conf.get("spark.sql.shuffle.partitions"))}
