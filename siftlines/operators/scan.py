"""Rule scanning: which line of which file does which rule hit."""

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlines import session
from siftlines.functions import catalog, lookups, text
from siftlines.functions.catalog import Rule
from siftlines.operators import lines as line_ops

# What a line must contain for any catalogue rule of its language to match.
# Cheap byte searches drop most lines before a regex runs.
_GATE = """
    contains(text, '(')
    or (language <> 'c' and contains(text, '='))
    or (language = 'javascript' and (contains(text, ':') or contains(text, '__dirname')
                                     or contains(text, 'dangerouslySetInnerHTML')))
    or (language = 'python' and contains(text, '@csrf_exempt'))
    or (language = 'java' and contains(text, '${'))
    or contains(if(language = 'java', upper(text), text), 'AKIA')
"""

# A rule table of up to this many bytes is sent to every executor; a larger one is shuffled to.
BROADCAST_RULE_BYTES = 32 << 20
# Rules one row of a prepared rule table holds, on average.
BATCH_RULES = 64
# Characters of a run of the rule index; its runs are counted on one line in so many.
GRAM = 3
SAMPLE_EVERY = 16
# A place in a run of literal characters where a word begins or ends.
_EDGE = "\uffff"
# Characters that are equal to another when case is ignored and lower() leaves apart, and what they become; a capital sigma does not
# depend on its place.  The iota below a letter is none: it is no part of a word.
_ODD = {c: c.upper().lower() for c in map(chr, range(0x80, 0x20000)) if len(c.upper()) == 1 and c.upper().lower() != c.lower()}
_ODD = {c: to for c, to in _ODD.items() if len(to) == 1 and c != "\u0345"} | {"\u0130": "i", "\u0131": "i", "\u03a3": "\u03c3"}
_IOTAS = re.compile("[\u0345\u0399\u03b9\u1fbe]")
# Rules a language may have in the rule index under no key at all; beyond that they are found by runs.
UNKEYED_RULES = 64


def _ignores_case(language: str) -> bool:
    return language == "java"


def java_pattern(pattern: str, language: str) -> str:
    """The pattern as Spark's regex engine has to see it."""
    return ("(?iu)" if _ignores_case(language) else "") + text.unicode_regex(pattern)


def _probe() -> Column:
    """What anchors are searched in: case-folded where rules ignore case."""
    folded = F.lower(F.translate(F.col("text"), "\u0130\u0131\u017f\u212a", "iisk"))
    return F.when(F.col("language") == "java", folded).otherwise(F.col("text"))


def _condition(rule: Rule, language: str) -> str:
    parts = []
    if rule.anchor:
        anchor = rule.anchor.lower() if _ignores_case(language) else rule.anchor
        parts.append(f"contains(probe, {text.quoted(anchor)})")
    parts.append(f"rlike(text, {text.quoted(java_pattern(rule.pattern, language))})")
    parts += [f"not rlike(text, {text.quoted(java_pattern(p, language))})" for p in rule.exclude]
    return " and ".join(parts)


def _hits(rules: list[Rule]) -> Column:
    """Array of the positions of all rules that hit a line, by its language.

    Alternatives of one rule on one line are one hit: the first that matches.
    """
    branches = []
    for language in catalog.EVERY_LANGUAGE:
        alternatives: dict[str, list[tuple[int, Rule]]] = {}
        for i, rule in enumerate(catalog.for_language(rules, language)):
            alternatives.setdefault(rule.rule_id, []).append((i, rule))
        marks = ", ".join("case " + " ".join(f"when {_condition(r, language)} then {i}" for i, r in same) + " end"
                          for same in alternatives.values())
        if marks:
            branches.append(f"when language = '{language}' then array_compact(array({marks}))")
    return F.expr("case " + " ".join(branches) + " end") if branches else F.array().cast("array<int>")


def finding_columns() -> list[Column]:
    return [F.col("rule_id").alias("check_id"), F.col("path").alias("file"), F.col("line"),
            F.col("message"), F.col("severity"),
            text.snippet(F.col("text"), lookups.SCAN_SNIPPET_CHARS).alias("snippet"),
            F.col("ord").alias("rule_ord")]


def scan_line_table(lines: DataFrame, rules: list[Rule], gated: bool = False) -> DataFrame:
    """Findings of literal rules on lines(path, language, line, text).

    Every pattern is a literal, so it is compiled once per task, and the whole
    scan is one pass over the lines without a shuffle.  ``gated`` may be set
    for catalogue rules, whose needed characters are known.
    """
    kept = lines.where(_GATE) if gated else lines
    hits = (kept.withColumn("probe", _probe())
            .select("path", "language", "line", "text", F.explode(_hits(rules)).alias("ord")))
    # These rules are code, so their number is known.
    table = F.broadcast(catalog.rules_table(lines.sparkSession, rules))
    return hits.join(table, ["language", "ord"]).select(*finding_columns())


def scan(files: DataFrame, rules: list[Rule] | DataFrame | None = None) -> DataFrame:
    """Findings of files(path, content, language).

    ``rules`` is a list of rules, or a table with the columns of
    ``catalog.rules_table`` to which a user may have added rows; by default the
    built-in line rules.  Files of other languages give no findings.
    """
    if isinstance(rules, DataFrame):
        return scan_with_rule_table(files, rules)
    lines = line_ops.scan_lines(files, "language")
    if rules is None:
        return scan_line_table(lines, catalog.line_rules(), gated=True)
    return scan_line_table(lines, rules)


def _prepared(batches):
    for batch in batches:
        rows = [_translated(*row) for row in zip(batch["language"], batch["pattern"], batch["exclude"])]
        needed = [[] if row[2] else _needed(pattern) for row, pattern in zip(rows, batch["pattern"])]
        batch["literals"] = [_plain(lists) for lists in needed]
        batch["words"] = [_whole_words(lists) for lists in needed]
        batch["exact"] = [None if row[1] or row[2] else _only_word(pattern) for row, pattern in zip(rows, batch["pattern"])]
        batch["pattern"], batch["exclude"], batch["error"] = zip(*rows) if rows else ([], [], [])
        yield batch[["rule_id", "language", "ord", "severity", "message", "pattern", "exclude", "literals", "words", "exact", "error"]]


def _translated(language, pattern, exclude):
    """A rule's patterns for Spark's regex engine, and what is wrong with them."""
    exclude = [] if exclude is None else list(exclude)
    try:
        for each in (pattern, *exclude):
            re.compile(each)
    except (re.error, TypeError) as problem:
        return None, [], str(problem)
    return java_pattern(pattern, language), [java_pattern(p, language) for p in exclude], None


def prepared_rules(rules: DataFrame) -> DataFrame:
    """A user's rules, one row per language they run on, with patterns for Spark's engine.

    ``rules`` has the columns of ``catalog.rules_table``, and may have ``exclude``: patterns that must not match.
    A shared rule runs on every language.  A rule whose pattern is no regular expression keeps
    what is wrong with it in ``error``.
    """
    if "exclude" not in rules.columns:
        rules = rules.withColumn("exclude", F.array().cast("array<string>"))
    every = F.array(*[F.lit(x) for x in catalog.EVERY_LANGUAGE])
    language = F.explode(F.when(F.col("language") == catalog.SHARED, every).otherwise(F.array("language")))
    named = rules.select("rule_id", language.alias("language"), F.col("ord").cast("int").alias("ord"), "severity",
                         "message", "pattern", "exclude")
    return named.mapInPandas(_prepared, "rule_id string, language string, ord int, severity string, message string, "
                                        "pattern string, exclude array<string>, literals array<array<string>>, words array<string>, exact string, error string"
                             ).select("rule_id", "language", "ord", "severity", "message", "pattern", "exclude", "literals", "words", "exact", "error")


def rule_errors(rules: DataFrame) -> DataFrame:
    """Rules of a table that cannot run: (rule_id, language, error)."""
    return prepared_rules(rules).where("error is not null").select("rule_id", "language", "error")


def scan_with_rule_table(files: DataFrame, rules: DataFrame, salts: int | None = None,
                         broadcast_bytes: int = BROADCAST_RULE_BYTES) -> DataFrame:
    """Findings of a user's rule table, whatever its number of rows.

    Rules are rows of batches, all rows of one rule in the same; a file meets every batch of its language and
    tries one rule after the other on all its lines, so a pattern is compiled once per file.  One rule gives one
    finding per line, that of its smallest ``ord``.  A table of up to ``broadcast_bytes`` (its size is
    measured) goes to every executor and files stay where they are; beyond it files and
    batches meet by (language, salt).  Rules that cannot run are left out, see ``rule_errors``.
    """
    spark = files.sparkSession
    usable = prepared_rules(rules).where("error is null")
    size, number = usable.agg(
        F.coalesce(F.sum(F.octet_length("pattern") + F.octet_length("message") + 200), F.lit(0)), F.count("*")).first()
    batch = F.pmod(F.xxhash64("rule_id"), F.lit(number // BATCH_RULES + 1)).alias("batch")
    rule = F.struct("rule_id", "ord", "severity", "message", "pattern", "exclude")
    batches = usable.groupBy("language", batch).agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    lined = files.select("path", "language", "content")
    if size <= broadcast_bytes:
        met = lined.join(F.broadcast(batches), "language")
    else:
        salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")
        met = lined.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts))).join(
            batches.select("*", salt), ["language", "salt"])
    found = met.select("path", F.explode(_rule_hits(text.split_lines(F.col("content")))).alias("hit"))
    return found.select(
        F.col("hit.rule_id").alias("check_id"), F.col("path").alias("file"), "hit.line", "hit.message", "hit.severity",
        text.snippet(F.col("hit.text"), lookups.SCAN_SNIPPET_CHARS).alias("snippet"), F.col("hit.ord").alias("rule_ord"))


def _matches(line: Column, pattern: Column) -> Column:
    """``rlike`` for patterns in a column: this function compiles one only when it differs from the last."""
    return F.regexp_instr(line, pattern) > 0


def _rule_hits(lines: Column) -> Column:
    """Hits of the column ``rules`` on an array of lines, the first of each rule and line."""
    def tried(numbered):
        def one(rule):
            hit = lambda x: _matches(x["text"], rule["pattern"]) & ~F.exists(
                rule["exclude"], lambda p: _matches(x["text"], p))
            return F.transform(F.filter(numbered, hit), lambda x: F.struct(
                rule["rule_id"].alias("rule_id"), x["line"].alias("line"), rule["ord"].alias("ord"),
                rule["message"].alias("message"), rule["severity"].alias("severity"), x["text"].alias("text")))
        return F.array_sort(F.flatten(F.transform("rules", one)))

    def first(hits):
        before = lambda i: F.get(hits, i - 1)
        return F.filter(hits, lambda h, i: (i == 0) | (before(i)["rule_id"] != h["rule_id"])
                        | (before(i)["line"] != h["line"]))

    numbered = F.transform(lines, lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    return text.let(text.let(numbered, tried), first)


def _size(run: str) -> int:
    return len(run.replace(_EDGE, ""))


def _literals(parsed, whole: list, run: str = "") -> str:
    """Collects in ``whole`` what every match holds, as lists of alternatives; gives the run of characters that is still going on."""
    def end(run):
        if _size(run) >= GRAM:
            whole.append([run])
        return ""

    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            run += chr(value).lower() if value < 128 else chr(value) if chr(value) != _EDGE else " "
        elif name == "SUBPATTERN":
            run = _literals(value[-1], whole, run)
        elif name in ("AT", "ASSERT_NOT", "ASSERT"):
            run += _EDGE if str(value) == "AT_BOUNDARY" else ""  # takes up no characters
        else:
            run = end(run)
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                end(_literals(value[2], whole))
            elif name == "ATOMIC_GROUP":
                end(_literals(value, whole))
            elif name == "BRANCH":
                each = []
                for branch in value[1]:
                    own: list = []
                    rest = _literals(branch, own)
                    each.append(max([alternatives for alternatives in own + ([[rest]] if _size(rest) >= GRAM else [])],
                                    key=lambda a: min(map(_size, a)), default=None))
                if all(each):
                    whole.append([literal for alternatives in each for literal in alternatives])
    return run


def _needed(pattern: str) -> list[list[str]]:
    whole: list[list[str]] = []
    rest = _literals(re._parser.parse(pattern), whole)
    return whole + ([[rest]] if _size(rest) >= GRAM else [])


def _plain(lists: list[list[str]]) -> list[list[str]]:
    """The ASCII parts of lists of runs."""
    found = []
    for alternatives in lists:
        parts = [[part for part in re.findall(r"[\x00-\x7f]+", run.replace(_EDGE, "")) if len(part) >= GRAM] for run in alternatives]
        if len(parts) == 1:
            found += [[part] for part in parts[0]]
        elif all(parts):
            found.append([max(each, key=len) for each in parts])
    return found


def required_literals(pattern: str) -> list[list[str]]:
    """Texts of at least ``GRAM`` ASCII characters, in small letters: of each list every match of the pattern holds one."""
    return _plain(_needed(pattern))


def _kind(char: str) -> str:
    """w: part of a word, e: none, which any version of Unicode agrees on; else empty."""
    if char == _EDGE or char == "_":
        return "e" if char == _EDGE else "w"
    kind = unicodedata.ucd_3_2_0.category(char)
    return "w" if kind[0] in "LN" else "e" if kind != "Cn" else ""


def _longest_word(run: str) -> str:
    # A word is whole where something that is no part of a word stands on both sides of it in the run.
    best, word, open_ = "", "", False
    for char in run:
        kind = _kind(char)
        if kind == "w":
            word += char
            continue
        if kind and open_ and len(word) > len(best) and not _IOTAS.search(word):
            best = word
        word, open_ = "", bool(kind)
    return best


def _whole_words(lists: list[list[str]]) -> list[str]:
    words = [[_longest_word(run) for run in alternatives] for alternatives in lists]
    return max((each for each in words if all(each)), key=lambda each: min(map(len, each)), default=[])


def required_words(pattern: str) -> list[str]:
    """Words of which a line that the pattern matches has one as a whole word, in either case. Empty if that is not known."""
    return _whole_words(_needed(pattern))


def _only_word(pattern: str) -> str | None:
    """The word, if the pattern is that of one whole word and no more."""
    word = pattern[2:-2]
    plain = pattern.startswith(r"\b") and pattern.endswith(r"\b") and len(pattern) > 4 and all(_kind(c) == "w" for c in word)
    return word if plain and required_words(pattern) else None


def _grams(folded: Column) -> Column:
    """The different runs of ``GRAM`` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), 1))


def _folded(line: Column) -> Column:
    """The line, in which characters that are equal when case is ignored are the same."""
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(
        F.lower(F.translate(line, "".join(_ODD), "".join(_ODD.values()))))


def _words(line: Column) -> Column:
    """The different words of a line, and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(line, r"[^\p{L}\p{N}_]+")))


def _run_keys(grams: Column) -> Column:
    """Runs as keys that no word is equal to."""
    return F.transform(grams, lambda gram: F.concat(F.lit(" "), gram))


def _run_index(rules: DataFrame, lines: DataFrame) -> DataFrame:
    """(language, key, rule): under which runs of a line each rule with literals is tried."""
    # A rule's lists of alternatives, and the runs of each alternative.
    lists = rules.select("language", "rule", F.posexplode("rule.literals").alias("nth", "alternatives"))
    runs = lists.select("language", "rule", "nth", F.posexplode("alternatives").alias("branch", "literal")).select(
        "language", "rule", "nth", "branch", F.explode(_grams(F.col("literal"))).alias("gram"))
    some = lines.where(F.pmod(F.xxhash64("path", "line"), F.lit(SAMPLE_EVERY)) == 0)
    counts = some.select("language", F.explode(_grams(_folded(F.col("text")))).alias("gram")).join(
        runs.select("language", "gram").distinct(), ["language", "gram"]).groupBy("language", "gram").agg(F.count("*").alias("n"))
    counted = runs.join(counts, ["language", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("language", "rule", "nth", "branch").agg(F.min(F.struct("n", "gram")).alias("best"))
    of_list = rarest.groupBy("language", "rule", "nth").agg(F.sum("best.n").alias("n"), F.collect_set("best.gram").alias("grams"))
    chosen = of_list.groupBy("language", "rule").agg(F.min_by("grams", F.struct("n", "nth")).alias("grams"))
    return chosen.select("language", F.explode(_run_keys(F.col("grams"))).alias("key"), "rule")


def scan_with_rule_index(files: DataFrame, rules: DataFrame, keep=None, unkeyed: int = UNKEYED_RULES) -> DataFrame:
    """Findings of a rule table, those of ``scan_with_rule_table``, for tables of thousands of rules.

    Every match of most rules holds some literal text.  Where that has a whole word, the word is the rule's entry in an inverted
    index, and the rule is tried only on lines with the word; a rule of one word and no more is
    not tried at all.  Of other texts the rarest run of ``GRAM`` characters (counted on one
    line in ``SAMPLE_EVERY``; which it is changes no finding) is the entry; a rule of alternatives has one for each.  Up to ``unkeyed`` such
    rules a language are tried on every line that holds their text instead, which spares the runs of every line.  The planner broadcasts
    the index if it is small enough.  Rules without such a text go the way of ``scan_with_rule_table``.
    """
    keep = keep or session.Run(files.sparkSession).keep
    rule = F.struct("rule_id", "ord", "pattern", "exclude", "literals", "words", "exact", "apart", F.monotonically_increasing_id().alias("no"))
    # Findings of rules without any ASCII text stay apart where a path comes twice, as in ``scan_with_rule_table``.
    apart = (F.min(F.size("literals")).over(Window.partitionBy("rule_id")) == 0).alias("apart")
    usable = keep(prepared_rules(rules).where("error is null").select("*", apart).select("language", "severity", "message", rule.alias("rule")))
    lines = line_ops.scan_lines(files, "language")
    by_word = usable.where(F.size("rule.words") > 0).select("language", F.explode(F.array_distinct(
        F.transform("rule.words", _folded))).alias("key"), "rule")
    others = usable.where((F.size("rule.literals") > 0) & (F.size("rule.words") == 0))
    most = others.groupBy("language").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    by_run = most > unkeyed
    index = keep(by_word.unionByName(
        _run_index(others, lines) if by_run else others.select("language", F.lit("").alias("key"), "rule")))
    folded = lines.withColumns({"folded": _folded(F.col("text")), "line_no": F.monotonically_increasing_id()})
    words = _words(F.col("text"))
    keys = F.concat(words, _run_keys(_grams(F.col("folded")))) if by_run else words
    # The outer form keeps the optimizer from testing the array's size in a filter, which would work the keys out twice.
    met = folded.select("path", "language", "line", "text", "folded", "line_no", F.explode_outer(keys).alias("word")).withColumn(
        "key", _folded(F.col("word"))).join(index, ["language", "key"])
    whole = F.forall("rule.literals", lambda each: F.exists(each, lambda literal: F.contains(F.col("folded"), literal)))
    tried = whole & _matches(F.col("text"), F.col("rule.pattern")) & ~F.exists(
        "rule.exclude", lambda p: _matches(F.col("text"), p))
    ascii_ = lambda c: F.octet_length(c) == F.char_length(c)
    # Words of ASCII that are under one key differ in nothing but case.
    same = (F.col("word") == F.col("rule.exact")) | (
        F.col("language").isin(*filter(_ignores_case, catalog.EVERY_LANGUAGE)) & ascii_(F.col("word")) & ascii_(F.col("rule.exact")))
    sure = F.when(F.col("rule.exact").isNotNull() & (same | ~F.col("language").isin(*filter(_ignores_case, catalog.EVERY_LANGUAGE))), same)
    # Only what is shown of a line is carried on, and only if it is asked for; numbers are put together without a sort.
    found = met.where(F.coalesce(sure, tried)).select(
        F.col("rule.rule_id").alias("check_id"), F.col("path").alias("file"), "line", "rule.ord", "rule.no", F.when(F.col("rule.apart"), F.col("line_no")).alias("apart"),
        text.snippet(F.col("text"), lookups.SCAN_SNIPPET_CHARS).alias("snippet"))
    found = found.groupBy("check_id", "file", "line", "apart").agg(
        F.min_by("no", "ord").alias("no"), F.min("ord").alias("rule_ord"), F.min_by("snippet", "ord").alias("snippet"))
    found = found.join(usable.select("rule.no", "severity", "message"), "no").select(
        "check_id", "file", "line", "message", "severity", "snippet", "rule_ord")
    # All rows of one rule go the same way, so that the smallest ``ord`` is found.
    plain = rules.join(usable.where((F.size("rule.literals") == 0) & (F.size("rule.words") == 0)).select("rule.rule_id").distinct(), "rule_id", "left_semi")
    return found.join(plain.select(F.col("rule_id").alias("check_id")).distinct(), "check_id", "left_anti").unionByName(
        scan_with_rule_table(files, plain))


def first_found(primary: DataFrame, scanned: DataFrame) -> DataFrame:
    """Findings of another scanner, plus ``scanned`` for every file it found nothing in."""
    rest = scanned.join(primary.select("file").distinct(), "file", "left_anti")
    return primary.unionByName(rest, allowMissingColumns=True)


def with_fallback(files: DataFrame, primary: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Findings of another scanner, plus a scan of every file it found nothing in.

    All files are scanned where they lie and the findings of covered files are
    dropped afterwards: findings are small, whereas leaving covered files out
    first would shuffle the contents of all the others.
    """
    return first_found(primary, scan(files, rules))
