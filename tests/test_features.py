import pytest
from pyspark.sql import functions as F

from siftlines.functions import lexical
from siftlines.operators import blocks, features, sequence


def test_masking_keeps_lines(one):
    code = 'a = "x(1)" # f(2)\n"""b\nc(3)"""\nd = \'\\\'e(4)\'\ng(5)'
    masked = one(lexical.masked(F.col("c"), F.lit("python")), c=code)
    assert masked.count("\n") == code.count("\n")
    assert masked == 'a =  \n\n\nd = \ng(5)'
    js = "a /* b(\n c( */ d(`x(\n`) // e(\n'f(' g()"
    assert one(lexical.masked(F.col("c"), F.lit("javascript")), c=js) == "a \n d(\n) \n g()"


@pytest.mark.parametrize("path, code, sources, sinks, complexity", [
    ("a.py", "def open(x): pass\nif a and b or c:\n  open(p)\n  for x in input(): eval(x)\nelif z: cursor.execute(q)\n"
             "try: pass\nexcept E: os.system(c)\nwhile foo().execute(x): db.execute(y)\nexecute(z)\nz = [i for i in j if i]",
     ["open", "input"], ["eval", "cursor.execute", "os.system", "execute"], 7),
    ("a.js", "if (a && b || c) { prompt('x'); }\nfor (let i = 0; i < 1; i++) eval(x);\nfor (const k of m) { }\n"
             "switch (x) { case 1: document.write(y); break; default: }\ntry {} catch (e) {}\nel.innerHTML = 1; new eval(z);",
     ["prompt"], ["eval", "document.write"], 6),
    ("a.java", "if (a) { r.getParameter(\"q\"); new ProcessBuilder(c); }\nfor (int i = 0; i < 2; i++) { }\n"
               "for (String s : all) { }\nswitch (x) { case 1: default: }\nwhile (b) { }",
     ["getParameter"], [], 5),
    ("a.c", "int read(int x) { return gets(b) && p->read(1); }\nswitch (x) { case 1: strcpy(a, b); default: scanf(f); }",
     ["gets", "scanf"], ["gets", "strcpy"], 3)])
def test_features(files, path, code, sources, sinks, complexity):
    row = features.features(files((path, code))).collect()[0]
    assert (row.sources, row.sinks, row.complexity) == (sources, sinks, complexity)


@pytest.mark.parametrize("path, code, branches", [
    ("a.c", "do {} while(x); for(;;){} do x++; while (x < 3);\nif(a) {}\nelse do { y(); } while (z);\nwhile (q) { }", 3),
    ("a.java", "class A { void f() { do { } while(x);\n for(int i=0;i<2;i++) { } if(a) { } } }", 2),
    ("a.js", "do {\n} while (x);\nwhile (y) { a.do(z); double(); }\nconst o = { do: 1 };", 1)])
def test_loops_that_end_in_their_condition(files, path, code, branches):
    assert features.features(files((path, code))).collect()[0].complexity == branches


@pytest.mark.parametrize("quote", ['"', "'", "`"])
def test_very_many_escapes(one, quote):
    code = "a(" + quote + "\\u0041" * 100_000 + quote + ");\nb()"
    assert one(lexical.masked(F.col("c"), F.lit("javascript")), c=code) == "a();\nb()"


def test_regex_literals_are_masked(one, files):
    mask = lambda c: one(lexical.masked(F.col("c"), F.lit("javascript")), c=c)
    assert mask("x = /[{\"]/g.test(s); y = a / b / c; return /[/{]\\/\"/;") == "x = .test(s); y = a / b / c; return ;"
    code = "function f(){ return /[{]/; }\nfunction g(){ }"
    assert [r.name for r in blocks.code_blocks(files(("a.js", code))).collect()] == ["f", "g"]


def test_script_calls(spark):
    pages = spark.createDataFrame([("p", "<script>a(1);</script><p>b(2)</p><script src=x>c.d('e(')</script>")],
                                  "path string, html string")
    assert [r.call for r in features.call_sites(features.script_files(pages)).orderBy("call_no").collect()] == ["a", "c.d"]


def found(files, code):
    return {(r.check_id, r.line) for r in sequence.sequence_findings(files(("a.c", code))).collect()}


def test_repeated_free_and_use_after_free(files):
    code = "void f() {\n  free(p);\n  free(q);\n  // free(q);\n  free(p);\n  q->x = 1;\n}\nvoid g() {\n  free(p);\n}\nfree(z);\nfree(z);"
    assert found(files, code) == {("c-double-free", 2), ("c-use-after-free", 3)}


def test_allocation_needs_a_check_before_its_use(files):
    code = ("int f() {\n  a = malloc(1);\n  a->x = 1;\n  b = (struct t *) malloc(2);\n  if (b == NULL) return 1;\n  b->x = 1;\n"
            "  c = malloc(3);\n  if (!c) return 2;\n  c->x = 1;\n  d = malloc(4);\n  if (d && d->x) use(d);\n"
            "  e = malloc(5);\n  e->x = 1;\n  if (NULL == e) return 3;\n}")
    assert found(files, code) == {("c-null-deref-no-check", 2), ("c-null-deref-no-check", 12)}


def test_sequence_rules_equal_pairing_all_lines(files):
    import random
    rng = random.Random(3)
    pool = ["free(%s);", "%s->x = 1;", "%s = malloc(4);", "if (%s == NULL) return;", "y = 1;"]
    lines = ["void f() {"] + ["  " + (c % rng.choice("pqr") if "%" in c else c)
                              for c in (rng.choice(pool) for _ in range(80))] + ["}"]
    kinds = {"free(": "free", "->": "use", "malloc": "malloc", "== NULL": "check"}
    events = [(n, kind, line.split("free(")[-1].strip()[0] if kind == "free" else line.replace("if (", "").strip()[0])
              for n, line in enumerate(lines, 1) for mark, kind in kinds.items() if mark in line]
    want = set()
    for n, kind, var in events:
        ahead = [(m, k) for m, k, v in events if v == var and m > n]
        if kind == "free" and any(k == "free" for _, k in ahead):
            want.add(("c-double-free", n))
        if kind == "free" and any(k == "use" for _, k in ahead):
            want.add(("c-use-after-free", n))
        nearest = [k for _, k in ahead if k in ("use", "check")][:1]
        if kind == "malloc" and nearest == ["use"]:
            want.add(("c-null-deref-no-check", n))
    assert found(files, "\n".join(lines)) == want


def test_calls_are_read_from_their_parentheses(spark):
    plan = spark.createDataFrame([("f(x)", "python")], "c string, l string").select(
        lexical.calls(F.col("c"), F.col("l")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # no pattern is tried at every character
    for code, names in [("a b.c (d(e)) f", ["b.c", "d"]), ("new X(y(1))", ["y"]), ("p->go(int  **f(g\n(1)))", ["g"]),
                        ("xnew y((z)(", ["y"]), ("", []), ("int\t\U00010400(\U00010400a(", ["\U00010400a"]), ("d\u00e9.f (", ["d\u00e9.f"])]:
        row = spark.createDataFrame([(code, "python")], "c string, l string").select(
            lexical.calls(F.col("c"), F.col("l")).alias("n")).first()
        assert row.n == names, code
