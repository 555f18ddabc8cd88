"""The code corpus the queries run on: every document with code appended.

Prose hardly ever hits a rule, so each document becomes a source file: its
language follows from its id, and code lines picked by its id are appended.
Among them is one for every rule, after a line end of one kind or another.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlines.functions import catalog
from siftlines.plans.rule_lines import CASES, RULE_FILE_CASES

LANGUAGE_ORDER = ["python", "javascript", "java", "c"]
SUFFIX = {"python": "py", "javascript": "js", "java": "java", "c": "c"}

LINES = {
    "python": ["os.system(cmd)", 'cursor.execute(f"SELECT {x}")', "h = hashlib.md5(data)",
               "print(result)", "total = a + b"],
    "javascript": ["el.innerHTML = value;", "const r = Math.random();", "fetch(url);",
                   'console.log("password " + p);', "const z = 1;"],
    "java": ["Object o = new ObjectInputStream(in).readObject();", 'String password = "hunter22";',
             'MessageDigest.getInstance("MD5");', 'stmt.executeQuery("SELECT " + x);', "int z = 1;"],
    "c": ["strcpy(dst, src);", "system(cmd);", "int k = rand();", "char *p = malloc(n * m);", "int z = 1;"],
}

BLOCKS = {
    "python": [
        "@app.route('/x')\ndef handler(req):\n    if req and ready():\n        return eval(req)\n\n    return open(name)",
        "class Store:\n    def get(self, key):\n        for k in self.keys:\n            os.popen(k)\n        return None\nDONE = 1",
        "async def poll():\n    while True:\n        data = input()\n        pickle.loads(data)",
        "def one(): pass\ndef two(a,\n        b):\n    return a or b",
        "x = 1\ny = 2",
    ],
    "javascript": [
        "function load(id) {\n  if (id && ok) {\n    eval(id);\n  }\n}",
        "app.get('/users', (req, res) => {\n  const q = \"{\";\n  document.write(q);\n});",
        "class View {\n  render() {\n    for (let i = 0; i < 3; i++) { setTimeout(tick, i); }\n  }\n}\nfunction after() { return 1; }",
        "router.use(express.json());\nconst k = 1;",
        "let y = 2;\nlet x = 1;",
    ],
    "java": [
        "class A {\n  @Override\n  public String name(int a) {\n    if (a > 0 && ok) { return \"}\"; }\n    return run(a);\n  }\n}",
        "class B {\n  void go() {\n    for (int i = 0; i < 3; i++) { work(i); }\n  }\n  int two() { return 2; }\n}",
        "class C {\n  private static List<String> all(HttpServletRequest r)\n  {\n    while (more()) { r.getParameter(\"q\"); }\n    return null;\n  }\n}",
        "interface D {\n  int size();\n}",
        "int y = 2;\nint x = 1;",
    ],
    "c": [
        "void f(struct node *p) {\n  free(p);\n  p->next = 0;\n}",
        "void g(char *q) {\n  free(q);\n  if (q) { use(q); }\n  free(q);\n}",
        "int h(void) {\n  struct node *n = malloc(8);\n  n->val = 1;\n  return 0;\n}",
        "int k(void) {\n  m = malloc(8);\n  if (m == NULL) return 1;\n  m->val = 1;\n  return read(0, b, 1) || gets(b);\n}",
        "int y;\nint x;",
    ],
}


# Lines a rule matches, with and without what exempts them.
GUARDED = {
    "python": ["doc = lxml.etree.parse(f, parser=p)", "doc = lxml.etree.parse(f)", "print(a)",
               'cursor.execute("a" + "b"); db.execute(q + x)'],
    "javascript": ['setTimeout("go()", 1); setTimeout(() => {}, 2);', 'setTimeout("go()", 1);',
                   'fetch("/a"); fetch(u);', "fetch(u);"],
    "java": ["int a = 1;", "int b = 1;", "new File(a + b);", "int c = 1;"],
    "c": ["memcpy(d, s, sizeof(d));", "memcpy(d, s, sizeof(s));", "memcpy(d, s, n);", 'printf("a"); printf(b);'],
}


def _planted() -> dict[str, list[str]]:
    """For each language a line that every one of its rules hits, and a clean one."""
    rules = [*catalog.line_rules(), *(r for r in catalog.rule_file_rules() if r.rule_id in RULE_FILE_CASES)]
    return {language: list(dict.fromkeys(
        {**CASES, **RULE_FILE_CASES}[r.rule_id][0] for r in catalog.for_language(rules, language))) + EXTRA[language]
        for language in LANGUAGE_ORDER}


# Lines for the readers of code: what is no bracket, what is no branch.
EXTRA = {
    "python": ["nothing = 1"],
    "javascript": ["nothing = 1;", "open = /[{(]/g;", "do { i++; } while (i < 3);"],
    "java": ["int nothing = 1;", "do { i++; } while (i < 3);"],
    "c": ["int nothing = 1;", "do { i++; } while (i < 3);"],
}

PLANTED = _planted()

# Line ends before the planted line; only the first ends a line for a reader.
ENDS = ["\n", "\x0c", "\x85", "\u2028"]


def _pick(table: dict, language: Column, index: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for name, entries in table.items():
        chosen = F.when(language == name,
                        F.element_at(F.array(*[F.lit(e) for e in entries]), (index + 1).cast("int"))).otherwise(chosen)
    return chosen


#: Partitions that documents are dealt to before anything is made of them; None: as they lie.  Of a table with one row group
#: only one task reads, so a caller that has more cores says so here or with ``partitions``; real tables have row groups enough.
PARTITIONS: int | None = None


def documents(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    wanted = partitions or PARTITIONS
    return docs.repartition(wanted) if wanted else docs


def code_files(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """files(path, content, language) with code in every file."""
    docs = documents(spark, sf_dir, partitions)
    language = F.element_at(F.array(*[F.lit(x) for x in LANGUAGE_ORDER]), (F.col("doc_id") % 4 + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(SUFFIX[x]) for x in LANGUAGE_ORDER]), (F.col("doc_id") % 4 + 1).cast("int"))
    digit = lambda step: F.floor(F.col("doc_id") / step) % 5
    end = F.element_at(F.array(*[F.lit(x) for x in ENDS]), (F.floor(F.col("doc_id") / 8) % 4 + 1).cast("int"))
    planted = F.lit(None).cast("string")
    for name, entries in PLANTED.items():
        number = F.floor(F.col("doc_id") / 4) % len(entries)
        planted = F.when(language == name, F.element_at(
            F.array(*[F.lit(e) for e in entries]), (number + 1).cast("int"))).otherwise(planted)
    # A row of one element: what is worked out here is a value to all that follows, not an expression to repeat.
    return docs.select(F.explode(F.array(F.struct(
        F.concat("source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), suffix).alias("path"),
        F.concat_ws("\n", "text", _pick(LINES, language, digit(4)), F.concat(_pick(LINES, language, digit(20)), end, planted),
                    _pick(BLOCKS, language, digit(100))).alias("content"),
        language.alias("language")))).alias("file")).select("file.*")


def guarded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code corpus with one more line per file."""
    number = F.regexp_extract("path", r"/f(\d+)\.", 1).cast("long")
    return code_files(spark, sf_dir).withColumn("content", F.concat_ws(
        "\n", "content", _pick(GUARDED, F.col("language"), F.floor(number / 4) % 4)))


# Calls over several lines: those that rules on calls hit, those that they spare, what only looks like one.
SPREAD = {
    "python": ['db.execute(\n    query\n    + name,\n)', "subprocess.run(\n    [tool,\n     'a'],\n    shell=True)",
               'db.execute("a"\n           + "b")', "# open(\n#   name)\ntext = 'open('\nx = (1,\n     2)",
               "print(requests.get(\n    url(a, 'b'),  # a, (b\n    timeout=3))"],
    "javascript": ['pool.query("select " +\n  id,\n  done);', "fetch(\n  base + path,\n  { method: 'GET' });",
                   "setTimeout(() => {\n  tick();\n}, 5);", "fetch('/a',\n  { method: 'GET' });",
                   "app.listen(port, () => {\n  pool.query(`select ${id}`,\n    done);\n});"],
    "java": ["run(a,\n  b);", "int a = 1;", "int b = 1;", "int c = 1;", "int d = 1;"],
    "c": ["memcpy(dst,\n  src,\n  sizeof(src));", "memcpy(dst,\n  src,\n  sizeof(dst));", "void strcpy(char *a,\n  char *b);",
          'printf("%d"\n  "%d");', "p = malloc(n\n  * m);"],
}


def spread_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code corpus with a call over several lines, or something like it, at the end of each file."""
    number = F.regexp_extract("path", r"/f(\d+)\.", 1).cast("long")
    return code_files(spark, sf_dir).withColumn("content", F.concat_ws(
        "\n", "content", _pick(SPREAD, F.col("language"), F.floor(number / 4) % 5)))


def prose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are, as JavaScript and as Java files."""
    docs = documents(spark, sf_dir).select(
        F.concat("source", F.lit("/f"), F.col("doc_id").cast("string")).alias("stem"),
        F.col("text").alias("content"),
        F.explode(F.array(F.lit("javascript"), F.lit("java"))).alias("language"))
    return docs.select(
        F.concat("stem", F.when(F.col("language") == "java", ".java").otherwise(".js")).alias("path"),
        "content", "language")
