"""The same queries as SQL text, for a second engine to check the results.

Written apart from the DataFrame code: regular expressions are spelled for a
linear-time engine without look-around, lists become unnested rows.
"""

import re

from siftlines.functions import catalog, lookups
from siftlines.functions.rule_values import (RULE_FILE_C, RULE_FILE_JAVA, RULE_FILE_JAVASCRIPT,
                                             RULE_FILE_PYTHON)
from siftlines.functions.text import WHITESPACE
from siftlines.plans import corpus
from siftlines.plans.queries import USER_RULES

_W, _NOT_W = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
_S = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"
_FINDING = "check_id, file, line, message, severity, snippet"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def regex(pattern: str, language: str = "") -> str:
    """A rule pattern for a linear-time engine."""
    out = pattern.replace(r'["\'\s]', r'["\'\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]')
    # The look-ahead can always be satisfied further right, so it decides nothing.
    out = out.replace(r"(?!httpOnly\s*:\s*true)", "").replace(r"(?!secure\s*:\s*true)", "")
    if out.startswith(r"\b"):
        out = f"(?:^|{_NOT_W})" + out[2:]
    out = out.replace(r"\b.*", f"{_NOT_W}.*")
    if out.endswith(r"\b"):
        out = out[:-2] + f"(?:{_NOT_W}|$)"
    out = re.sub(r"\\(.)", lambda m: {"w": _W, "s": _S, "d": r"\p{Nd}"}.get(m[1], m[0]), out)
    return ("(?i)" if language == "java" else "") + out


def strip(expr: str) -> str:
    return f"trim({expr}, {q(WHITESPACE)})"


def _case(subject: str, pairs, default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs)
    return f"CASE {subject} {whens} ELSE {default} END"


def _pick(table: dict, digit: str) -> str:
    branches = []
    for language, entries in table.items():
        listed = ", ".join(q(e) for e in entries)
        branches.append(f"WHEN {q(language)} THEN ([{listed}])[{digit} + 1]")
    return "CASE language " + " ".join(branches) + " END"


def _code_files() -> str:
    names = ", ".join(q(x) for x in corpus.LANGUAGE_ORDER)
    planted = "CASE language " + " ".join(
        f"WHEN {q(language)} THEN ([{', '.join(q(e) for e in entries)}])[(doc_id // 4) % {len(entries)} + 1]"
        for language, entries in corpus.PLANTED.items()) + " END"
    ends = ", ".join(q(corpus.SUFFIX[x]) for x in corpus.LANGUAGE_ORDER)
    return f"""
docs AS (
  SELECT doc_id, text, source, ([{names}])[doc_id % 4 + 1] AS language, ([{ends}])[doc_id % 4 + 1] AS ext
  FROM documents),
code_files AS (
  SELECT source || '/f' || doc_id || '.' || ext AS path, language,
         text || chr(10) || {_pick(corpus.LINES, '(doc_id // 4) % 5')}
              || chr(10) || {_pick(corpus.LINES, '(doc_id // 20) % 5')}
              || ([{", ".join(f"chr({ord(e)})" for e in corpus.ENDS)}])[(doc_id // 8) % 4 + 1] || {planted}
              || chr(10) || {_pick(corpus.BLOCKS, '(doc_id // 100) % 5')} AS content
  FROM docs)"""


_NO_BREAK = r"[^\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]+"
_BREAKS = r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _lines(files: str, name: str, keep: str = "path, language", content: str = "content", breaks: str = _BREAKS) -> str:
    """CTE ``name`` with one row per line of ``files``."""
    return f"""
{name}_split AS (
  SELECT {keep}, string_split(regexp_replace(regexp_replace({content}, {q(breaks)}, chr(10), 'g'), '\\n\\z', ''),
                              chr(10)) AS parts
  FROM {files} WHERE {content} <> ''),
{name} AS MATERIALIZED (
  SELECT {keep}, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line, unnest(parts) AS text
  FROM {name}_split)"""


def _excluded(pattern: str, language: str) -> str:
    if r"\1" not in pattern:
        return f"regexp_matches(text, {q(regex(pattern, language))})"
    # No back-references here: capture both names and compare them.
    both = q(regex(pattern.replace(r"\1", r"(\w+)"), language))
    return (f"(regexp_matches(text, {both}) AND regexp_extract(text, {both}, 1) = regexp_extract(text, {both}, 2))")


def _hits(rules, language: str, line_table: str, only=None) -> list[str]:
    out = []
    for order, r in enumerate(catalog.for_language(rules, language)):
        if only and r.rule_id not in only:
            continue
        wanted = [f"regexp_matches(text, {q(regex(r.pattern, language))})"]
        wanted += ["NOT " + _excluded(p, language) for p in r.exclude]
        out.append(f"SELECT {q(r.rule_id)} AS check_id, path AS file, line, {q(r.message)} AS message, "
                   f"{q(r.severity)} AS severity, text, {order} AS rule_ord FROM {line_table} "
                   f"WHERE language = {q(language)} AND {' AND '.join(wanted)}")
    return out


def _scan(name: str, rules, line_table: str = "lines", only=None) -> str:
    union = "\n  UNION ALL ".join(
        part for language in catalog.EVERY_LANGUAGE for part in _hits(rules, language, line_table, only))
    return f"""
{name}_raw AS ({union}),
{name} AS MATERIALIZED (
  SELECT check_id, file, line, message, severity,
         substring({strip('text')}, 1, {lookups.SCAN_SNIPPET_CHARS}) AS snippet, rule_ord
  FROM {name}_raw)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _found() -> list[str]:
    return [_code_files(), _lines("code_files", "lines"), _scan("found", catalog.line_rules())]


def _over_found(select: str, *more: str) -> str:
    return _with(*_found(), *more) + select


# Calls over several lines, spelled for this engine: rule, language, pattern of the whole call.
_SPREAD_CALLS = [
    ("python-sqli-string-concat", "python", r"\w+\.execute\(\s*\w+\s*\+\s*\w+\s*,?\s*\)"),
    ("python-command-injection-run", "python", r"subprocess\.run\(\s*\[[^\]]*\],\s*shell=True\s*\)"),
    ("python-ssrf-requests", "python", r"requests\.get\(\s*\w+\([^()]*\),[^\n]*\n[^()]*\)"),
    ("js-sqli-query-concat", "javascript", r"\w+\.query\((?:\"[^\"]*\"\s*\+\s*\w+|`[^`]*\$\{[^`]*`),\s*\w+\s*\)"),
    ("js-ssrf-fetch", "javascript", r"fetch\(\s*\w[^()]*\)"),
    ("c-memcpy-no-bounds", "c", r"memcpy\(dst,\s*src,\s*sizeof\(src\)\)"),
    ("c-integer-overflow-malloc", "c", r"malloc\(\w+\s*\*\s*\w+\)"),
]


def _spread_calls() -> str:
    about = {row[0]: (row[1], row[5]) for _, row in catalog.rule_file_rows()}
    marked = " UNION ALL ".join(
        f"SELECT {q(rule)} AS check_id, {q(about[rule][0])} AS severity, {q(about[rule][1])} AS message, path AS file, "
        f"string_split(regexp_replace(content, {q(pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts "
        f"FROM plain_files WHERE language = {q(language)} AND regexp_matches(content, {q(pattern)})"
        for rule, language, pattern in _SPREAD_CALLS)
    return f"""
spread_files AS (
  SELECT path, language, content || chr(10) || {_pick(corpus.SPREAD, "((CAST(regexp_extract(path, '/f([0-9]+)', 1) AS BIGINT) // 4) % 5)")} AS content
  FROM code_files),
plain_files AS MATERIALIZED (SELECT path, language, regexp_replace(content, {q(_BREAKS)}, chr(10), 'g') AS content FROM spread_files),
marked AS ({marked}),
numbered AS (SELECT *, unnest(range(1, len(parts))) AS n FROM marked),
hits AS (
  SELECT check_id, file, message, severity, string_split(parts[n + 1], chr(2))[1] AS call, array_to_string(parts[1:n], '') AS before,
         CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INTEGER) AS line
  FROM numbered)"""


# expressions ----------------------------------------------------------------------

def _weakness(m: str) -> str:
    return (f"CASE WHEN regexp_matches({m}, '\\[CWE-\\p{{Nd}}+\\]') THEN regexp_extract({m}, '\\[(CWE-\\p{{Nd}}+)\\]', 1) "
            f"WHEN regexp_matches({m}, '\\[CVE-[\\p{{Nd}}-]+\\]') THEN regexp_extract({m}, '\\[(CVE-[\\p{{Nd}}-]+)\\]', 1) "
            f"ELSE 'N/A' END")


def _category(m: str) -> str:
    keywords = " ".join(f"WHEN contains(lower({m}), {q(k)}) THEN {q(v)}" for k, v in lookups.KEYWORD_CATEGORY)
    by_id = _case(f"regexp_extract({m}, '\\[(CWE-\\p{{Nd}}+)\\]', 1)", lookups.WEAKNESS_CATEGORY.items(), "'Other'")
    return (f"CASE WHEN regexp_matches({m}, '\\[CWE-\\p{{Nd}}+\\]') THEN {by_id} "
            f"WHEN regexp_matches({m}, '\\[CVE-[\\p{{Nd}}-]+\\]') THEN 'Known CVE' {keywords} ELSE 'Other' END")


def _display(s: str) -> str:
    return _case(f"upper({s})", lookups.SEVERITY_DISPLAY.items(), f"upper({s})")


def _short(m: str) -> str:
    plain = (f"regexp_replace(regexp_replace({m}, '^\\[CWE-\\p{{Nd}}+\\]{_S}*', ''), "
             f"'^\\[CVE-[\\p{{Nd}}-]+\\]{_S}*', '')")
    return f"CASE WHEN length({plain}) > 60 THEN substring({plain}, 1, 57) || '...' ELSE {plain} END"


def _severity_score() -> str:
    e, w, i = (f"count(*) FILTER (WHERE severity = '{s}')" for s in ("ERROR", "WARNING", "INFO"))
    return (f"least(10.0, round(CASE WHEN {e} > 0 THEN 7 + ({e} - 1) + 0.5 * {w} + 0.1 * {i} "
            f"WHEN {w} > 0 THEN 4 + 0.5 * ({w} - 1) + 0.1 * {i} "
            f"WHEN {i} > 0 THEN 1 + 0.1 * ({i} - 1) ELSE 0 END, 1))::DOUBLE")


def _label(s: str) -> str:
    return f"CASE WHEN {s} >= 8 THEN 'CRITICAL' WHEN {s} >= 5 THEN 'HIGH' WHEN {s} >= 2 THEN 'MEDIUM' ELSE 'LOW' END"


_SCORED = f"""
scored AS (
  SELECT file, count(*) AS n_findings, {_severity_score()} AS risk_score FROM found GROUP BY file)"""

_READER_LINES = ("CAST(CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 "
                 "- (CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END) END AS INTEGER)")
_NEWLINES = "CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INTEGER)"


def _density(found: str = "found") -> str:
    return f"""
weights AS (
  SELECT file, count(*) AS n_findings,
         sum(CASE severity WHEN 'ERROR' THEN 3.0 WHEN 'WARNING' THEN 2.0 ELSE 0.5 END)::DOUBLE AS weight
  FROM {found} GROUP BY file),
density AS (
  SELECT path AS file, {_READER_LINES} AS reader_lines, coalesce(n_findings, 0) AS n_findings,
         CASE WHEN weight IS NULL THEN 0.0
              ELSE round_even(least(10.0, weight / ln(greatest({_READER_LINES}, 2)) * 5.0), 1) END::DOUBLE AS risk_score
  FROM code_files LEFT JOIN weights ON path = file)"""


# code without strings and comments ------------------------------------------------

_DOUBLE = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"'
_SINGLE = r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
_TEMPLATE = r"`[^`\\]*(?:\\[\s\S][^`\\]*)*`"
_TRIPLE = r'"""[\s\S]*?"""' + r"|'''[\s\S]*?'''"
_SLASHED = r"/\*[\s\S]*?\*/|//[^\n]*"
_BEFORE = r"[(,=:\[!&|?{};\n]"
_PIECES = {
    "python": (rf"{_TRIPLE}|{_DOUBLE}|{_SINGLE}|#[^\n]*|[^\"'#]+|[\s\S]",
               r"^(?:\"[^\n]*\"|'[^\n]*'|\"\"\"|'''|#)"),
    # No look-behind here: a literal is a piece together with the sign before it.
    "javascript": (rf"{_SLASHED}|{_BEFORE}[ \t]*/(?:[^/*\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])"
                   rf"(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])*/[a-z]*"
                   rf"|{_DOUBLE}|{_SINGLE}|{_TEMPLATE}|[^\"'`/(,=:\[!&|?{{}};\n]+|[\s\S]",
                   r"^(?:\"[^\n]*\"|'[^\n]*'|`[\s\S]*`|/\*|//)"),
    "java": (rf"{_SLASHED}|{_DOUBLE}|{_SINGLE}|[^\"'/]+|[\s\S]", r"^(?:\"[^\n]*\"|'[^\n]*'|/\*|//)"),
    "c": (rf"{_SLASHED}|{_DOUBLE}|{_SINGLE}|[^\"'/]+|[\s\S]", r"^(?:\"[^\n]*\"|'[^\n]*'|/\*|//)"),
}


def _masked(files: str = "code_files") -> str:
    branches = " ".join(
        f"WHEN {q(language)} THEN array_to_string(list_transform(regexp_extract_all(content, {q(pieces)}), "
        f"lambda p: CASE WHEN regexp_matches(p, '^[(,=:\\[!&|?{{}};\\n][ \\t]*/.') THEN regexp_replace(p, '/.*', '') "
        f"WHEN regexp_matches(p, {q(blank)}) THEN regexp_replace(p, {q(_NO_BREAK)}, '', 'g') ELSE p END), '')"
        for language, (pieces, blank) in _PIECES.items())
    return f"""
masked AS (
  SELECT path, language, content, CASE language {branches} END AS code FROM {files})"""


_CALL = (r"((?:->|(?:new|def|class|function|void|int|char|long|double|float|boolean|size_t|ssize_t|String)"
         r"[ \t]{1,4}\*{0,3})?[\p{L}\p{N}_.]+)" + r"\s*\(")
_BRANCH = {
    "python": r"(?m)^[ \t]*(?:if|elif|for|while|except|async[ \t]+for)\b|\b(?:and|or)\b",
    "javascript": r"\b(?:if|while)[ \t]*\(|\bfor[ \t]*\([^;){\n]*;|\b(?:case|catch)\b|\|\||&&",
    "java": r"\b(?:if|while)[ \t]*\(|\bfor[ \t]*\([^;){\n]*;|\b(?:case|default|catch)\b|\|\||&&",
    "c": r"\b(?:if|while|for)[ \t]*\(|\b(?:case|default)\b|\|\||&&",
}


def _features() -> str:
    def listed(table):
        parts = " ".join(f"WHEN {q(k)} THEN list_filter(names, lambda n: n IN ({', '.join(q(x) for x in v)}))"
                         for k, v in table.items())
        return f"CASE language {parts} END"
    # A loop that ends in its condition: as many as there are words that open one.
    loops = r"(?:^|[;{})\n\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]|\belse)[ \t]*do\b\s*[{\p{L}_(+*-]"
    less = lambda k: "" if k == "python" else f" - len(regexp_extract_all(code, {q(loops)}))"
    branch = " ".join(f"WHEN {q(k)} THEN greatest(0, len(regexp_extract_all(code, {q(v)})){less(k)})"
                      for k, v in _BRANCH.items())
    return f"""
called AS (
  SELECT path, language, code, content,
         CASE WHEN language = 'java'
              THEN list_transform(regexp_extract_all(code, {q(_CALL)}, 1), lambda n: regexp_replace(n, '^.*\\.', ''))
              ELSE regexp_extract_all(code, {q(_CALL)}, 1) END AS names
  FROM masked),
features AS (
  SELECT path, language, content, {listed(lookups.SOURCES)} AS sources, {listed(lookups.SINKS)} AS sinks,
         CAST(CASE language {branch} END AS INTEGER) AS complexity
  FROM called)"""


def _code_lines() -> str:
    return """
code_split AS (
  SELECT path, language, string_split(regexp_replace(content, BREAKS, chr(10), 'g'), chr(10)) AS raws,
         string_split(regexp_replace(code, BREAKS, chr(10), 'g'), chr(10)) AS codes FROM masked),
code_lines AS (
  SELECT path, language, line, raw, code FROM (
    SELECT path, language, CAST(unnest(range(1, len(raws) + 1)) AS INTEGER) AS line,
           unnest(raws) AS raw, unnest(codes) AS code FROM code_split)
  WHERE regexp_matches(code, '[^ \\t]'))""".replace("BREAKS", q(_BREAKS))


def _depths(language: str, opening: str, closing: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT path, line, raw, code, opened, closed,
         CAST(sum(opened - closed) OVER w AS INTEGER) AS after,
         CAST(sum(opened - closed) OVER w - opened + closed AS INTEGER) AS before
  FROM (SELECT *, length(code) - length(translate(code, {q(opening)}, '')) AS opened,
               length(code) - length(translate(code, {q(closing)}, '')) AS closed
        FROM code_lines WHERE language = {q(language)})
  WINDOW w AS (PARTITION BY path ORDER BY line))"""


_PY_BLOCKS = r"""
py_lines AS (
  SELECT path, line, regexp_matches(code, '^[^ \t)\]}]') AS top, starts_with(code, '@') AS decorator,
         nullif(regexp_extract(code, '^(?:async[ \t]+def|def|class)[ \t]+(\w+)', 1), '') AS name
  FROM code_lines WHERE language = 'python'),
py_tops AS (
  SELECT path, line, decorator, lag(decorator) OVER (PARTITION BY path ORDER BY line) AS below_decorator
  FROM py_lines WHERE top),
py_starts AS (
  SELECT path, line AS start, lead(line) OVER (PARTITION BY path ORDER BY line) AS next_start
  FROM py_tops WHERE NOT coalesce(below_decorator, false)),
py_blocks AS (
  SELECT s.path, min(l.name) FILTER (WHERE l.top) AS name, s.start AS first, max(l.line) AS last
  FROM py_starts s JOIN py_lines l ON l.path = s.path AND l.line >= s.start
       AND (s.next_start IS NULL OR l.line < s.next_start)
  GROUP BY s.path, s.start HAVING min(l.name) FILTER (WHERE l.top) IS NOT NULL)"""

_JS_BLOCKS = r"""
js_headers AS (
  SELECT path, line, coalesce(nullif(fn, ''), nullif(cls, ''),
                              CASE WHEN route <> '' AND arg <> '' THEN 'route_' || route || '_' || trim(arg, '''"') END) AS name,
         (fn <> '' OR cls <> '') AS block
  FROM (SELECT path, line, regexp_extract(code, '^[ \t]*(?:async[ \t]+)?function[ \t]+(\w+)', 1) AS fn,
               regexp_extract(code, '^[ \t]*class[ \t]+(\w+)', 1) AS cls,
               regexp_extract(code, '^[ \t]*(?:app|router|express)\.(get|post|put|delete|patch|use|route)[ \t]*\(', 1) AS route,
               regexp_extract(raw, '\([ \t]*(["''][^"''\n]*["'']|`[^`\n]*`|[\w.]+(?:\([^()\n]*\))?)', 1) AS arg
        FROM js_depth WHERE before = 0)),
js_blocks AS (
  SELECT h.path, h.name, h.line AS first,
         coalesce(min(d.line), CASE WHEN h.next_line IS NULL THEN
           (SELECT max(e.line) FROM js_depth e WHERE e.path = h.path) ELSE h.line END) AS last
  FROM (SELECT *, lead(line) OVER (PARTITION BY path ORDER BY line) AS next_line
        FROM js_headers WHERE name IS NOT NULL) h
  LEFT JOIN js_depth d ON d.path = h.path AND d.line >= h.line AND d.line < coalesce(h.next_line, 2147483647)
       AND d.closed > 0 AND d.after <= 0 AND greatest(d.after, d.before - 1) >= 0
       AND (NOT h.block OR contains(d.code, '}'))
  GROUP BY h.path, h.name, h.line, h.next_line)"""

_JAVA_WORDS = ("'new','return','else','throw','case','package','import','class','interface','enum','if','for',"
               "'while','switch','catch','try','do','synchronized','assert','instanceof'")
_JAVA_BLOCKS = r"""
java_marked AS (
  SELECT path, line, before, code, row_number() OVER (PARTITION BY path ORDER BY line) AS row,
         regexp_matches(code, '^[ \t]*@\w+(?:\([^)]*\))?[ \t]*$') AS annotation,
         regexp_extract(code, 'METHOD', 1) AS kind, regexp_extract(code, 'METHOD', 2) AS name
  FROM java_depth),
java_headers AS (
  SELECT m.path, m.line, m.before AS level, m.name,
         (regexp_matches(m.code, ';[ \t]*$') AND NOT contains(m.code, '{')) AS bodyless,
         (SELECT min(f.line) FROM java_marked f WHERE f.path = m.path AND f.row > coalesce(
            (SELECT max(b.row) FROM java_marked b WHERE b.path = m.path AND b.row < m.row AND NOT b.annotation), 0)) AS first
  FROM java_marked m WHERE m.name <> '' AND m.kind NOT IN (WORDS) AND m.name NOT IN (WORDS)),
java_ends AS (
  SELECT h.path, h.name, h.line, h.first,
         CASE WHEN h.bodyless THEN h.line ELSE coalesce(min(d.line),
           (SELECT max(e.line) FROM java_depth e WHERE e.path = h.path)) END AS last
  FROM java_headers h LEFT JOIN java_depth d ON d.path = h.path AND d.line >= h.line AND d.closed > 0
       AND d.after <= h.level AND greatest(d.after, d.before - 1) >= h.level
  GROUP BY h.path, h.name, h.line, h.first, h.bodyless),
java_blocks AS (
  SELECT path, name, first, last FROM (
    SELECT *, max(last) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
    FROM java_ends) WHERE reached IS NULL OR line > reached)""".replace(
    "METHOD", r"^[ \t]*(?:@\w+(?:\([^)]*\))?[ \t]+)*(?:(?:public|protected|private|static|final|abstract|synchronized"
    r"|native|default|strictfp)[ \t]+)*(?:<[^<>]*>[ \t]*)?([\w.]+)(?:<[^()]*>)?(?:\[\])*[ \t]+(\w+)[ \t]*\(").replace(
    "WORDS", _JAVA_WORDS)

_BLOCKS = """
blocks AS (
  SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY first) - 1 AS INTEGER) AS chunk_id, name,
         first - 1 AS start_line, last AS end_line
  FROM (SELECT path, name, first, last FROM py_blocks UNION ALL SELECT path, name, first, last FROM js_blocks
        UNION ALL SELECT path, name, first, last FROM java_blocks))"""


def _blocks() -> list[str]:
    return [_masked(), _code_lines(), _depths("javascript", "{([", "})]", "js_depth"),
            _depths("java", "{", "}", "java_depth"), _PY_BLOCKS, _JS_BLOCKS, _JAVA_BLOCKS, _BLOCKS]


def _windows(name: str, size: int, lines: str = "lines") -> str:
    return f"""
{name} AS (
  SELECT path, CAST((line - 1) // {size} AS INTEGER) AS chunk_id,
         'lines_' || min(line) || '_to_' || max(line) AS name, min(line) - 1 AS start_line, max(line) AS end_line,
         string_agg(text, chr(10) ORDER BY line) AS text
  FROM {lines} GROUP BY path, (line - 1) // {size})"""


def _bounds(size: int) -> list[str]:
    return [*_blocks(), _windows("windows", size), """
bounds AS (
  SELECT path, chunk_id, name, start_line, end_line FROM blocks
  UNION ALL SELECT path, chunk_id, name, start_line, end_line FROM windows
  WHERE path NOT IN (SELECT path FROM blocks))"""]


_TAGGED = """
tagged AS (
  SELECT f.*, b.name AS original_chunk, b.chunk_id FROM found f JOIN bounds b
  ON b.path = f.file AND f.line > b.start_line AND f.line <= b.end_line)"""


def _chunk_scores(bounds: str) -> str:
    return f"""
chunk_scored AS (
  SELECT path, language, chunk_id, b.name, b.start_line, b.end_line, b.text,
         count(check_id) AS n_findings, {_severity_score()} AS risk_score
  FROM {bounds} b JOIN (SELECT path, language FROM code_files) USING (path)
  LEFT JOIN found f ON f.file = path AND f.line > b.start_line AND f.line <= b.end_line
  GROUP BY path, language, chunk_id, b.name, b.start_line, b.end_line, b.text)"""


def _clean_summary(s: str) -> str:
    t = strip(s)
    reworded = (f"CASE WHEN lower({t}) LIKE 'summarize %' THEN 'Handles ' || {strip(f'substring({t}, 11)')} "
                f"WHEN lower({t}) LIKE 'summary for a single%' THEN 'Implements logic for a single' || substring({t}, 21) "
                f"WHEN lower({t}) LIKE 'summary for %' THEN 'Provides logic for ' || {strip(f'substring({t}, 13)')} "
                f"ELSE {t} END")
    return (f"(SELECT CASE WHEN w = '' THEN w ELSE upper(substring(w, 1, 1)) || substring(w, 2) || "
            f"CASE WHEN w LIKE '%.' THEN '' ELSE '.' END END FROM (SELECT {reworded} AS w))")


_READINGS = """
readings AS (
  SELECT user_id AS run_id, event_id AS sample_id, epoch_us(ts) AS at_us, event_type AS domain,
         least(value / 8, 100.0) AS cpu_percent,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1000000 / 1048576 AS memory_mb,
         CAST(round(value * 1000000) AS BIGINT) AS rapl_energy_uj
  FROM events),
rolled AS (
  SELECT run_id, count(*) AS n_samples, (max(at_us) - min(at_us)) / 1000000.0 AS wall_time_s,
         max(memory_mb) AS peak_memory_mb, avg(cpu_percent) AS avg_cpu_percent,
         arg_min(rapl_energy_uj, at_us * 1000000000::HUGEINT + sample_id) AS first_uj,
         arg_max(rapl_energy_uj, at_us * 1000000000::HUGEINT + sample_id) AS last_uj
  FROM readings GROUP BY run_id),
joules AS (
  SELECT *, wall_time_s * avg_cpu_percent / 100 AS cpu_time_s,
         greatest(last_uj - first_uj, 0) / 1000000.0 AS counted,
         28.0 * greatest(avg_cpu_percent / 100, 0.01) * (wall_time_s * avg_cpu_percent / 100) AS modelled
  FROM rolled)"""


def _report(joules: str, supported: str) -> str:
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in (
        "wall_time_s", "cpu_time_s", "peak_memory_mb", "avg_cpu_percent"))
    return (_with(_READINGS) + f"SELECT run_id, n_samples, {rounded}, round({joules}, 6) AS estimated_energy_j, "
            f"round({joules} / 3600000.0 * 475.0, 6) AS estimated_carbon_gco2, {supported} AS rapl_supported FROM joules")


_MERGE_ORDER = "origin, rule_ord"


def _distinct(source: str, order: str, columns: str) -> str:
    return (f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY file, line, message ORDER BY {order}) AS n "
            f"FROM {source}) WHERE n = 1")


_NARRATIVE = """
SELECT path, language, n_chunks, n_findings,
  substring('// Language: ' || language || chr(10) || CASE WHEN len(parts) > 0
    THEN '// Implements the following features: ' || array_to_string(parts[1:4], '; ') || '.' || chr(10)
         || 'function get_module_features() {}' || chr(10)
    ELSE '// General application module.' || chr(10) || 'function execute_module() {}' || chr(10) END, 1, 1000) AS module_prompt,
  trim('This module implements functional logic in ' || language || '. During the chunked analysis, the file was partitioned into '
    || n_chunks || ' logical components. ' || CASE WHEN n_findings = 0
    THEN 'Static analysis verified that this code is structurally sound and secure, with no vulnerabilities detected across its components. '
    ELSE 'A total of ' || n_findings || ' security vulnerabilities were detected. ' || CASE WHEN len(risky) > 0
      THEN 'Urgent security attention is required in the more vulnerable segments: ' || array_to_string(risky[1:3], ', ') || '. '
      ELSE 'The vulnerabilities are primarily minor warnings or info-level findings spread across the file. ' END END
    || CASE WHEN len(parts) > 0
      THEN 'Functionally, the key behaviors and responsibilities encapsulated by this code include: '
           || array_to_string((CASE WHEN len(calm) > 0 THEN calm ELSE parts END)[1:3], '; ') || '.' ELSE '' END) AS narrative
FROM (SELECT *, list_filter(parts, lambda p: NOT contains(lower(p), 'vulner') AND NOT contains(lower(p), 'security')) AS calm
      FROM told)"""


def _told(part: str) -> str:
    return f"""
parts AS (
  SELECT path, language, chunk_id, name, n_findings, risk_score,
         replace(rtrim({strip('s')}, '.'), chr(10), ' ') AS part, {strip('s')} AS whole
  FROM (SELECT *, {part} AS s FROM chunk_scored)),
told AS (
  SELECT path, language, count(*) AS n_chunks, CAST(sum(n_findings) AS BIGINT) AS n_findings,
         coalesce(list(part ORDER BY chunk_id) FILTER (WHERE whole <> '' AND whole <> 'Summary unavailable.'), []) AS parts,
         coalesce(list(name ORDER BY chunk_id) FILTER (WHERE risk_score >= 4), []) AS risky
  FROM parts GROUP BY path, language)"""


_TAG = f"CASE WHEN {_weakness('message')} = 'N/A' THEN '' ELSE ' (' || {_weakness('message')} || ')' END"


def _row(indent: str, tail: str) -> str:
    """A row of a findings table."""
    return f"""'{indent}Line ' || lpad(CAST(line AS VARCHAR), CAST(greatest(length(CAST(line AS VARCHAR)), 4) AS INTEGER), ' ') || '  [' ||
       rpad({_display('severity')}, CAST(greatest(6, length({_display('severity')})) AS INTEGER), ' ') || ']  ' || {_category('message')} ||
       rpad({_TAG}, CAST(greatest(24, length({_TAG})) AS INTEGER), ' ') || ' — ' || {_short('message')} || {tail}"""


_CHUNK_TEXTS = """
chunk_texts AS MATERIALIZED (
  SELECT b.path, any_value(l.language) AS language, chunk_id, string_agg(l.text, chr(10) ORDER BY l.line) AS text
  FROM bounds b JOIN lines l ON l.path = b.path AND l.line > b.start_line AND l.line <= b.end_line
  GROUP BY b.path, chunk_id),
chunk_files AS (SELECT path || '#' || chunk_id AS path, language, text AS content FROM chunk_texts)"""


def _audit() -> list[str]:
    """CTEs ``final`` and ``results`` of a folder audit in which files of over 20 lines are big."""
    return [*_found(), *_bounds(60), "\nwhole_bounds AS (SELECT *, '' AS text FROM bounds)", _chunk_scores("whole_bounds"),
            _told("'Summary unavailable.'"), f"\nnarrated AS ({_NARRATIVE})", _features(), f"""
sizes AS (SELECT path, {_NEWLINES} AS line_count FROM code_files),
final AS MATERIALIZED (
  SELECT check_id, file, line, message, severity, snippet, rule_ord
  FROM found JOIN sizes ON path = file
  QUALIFY line_count <= 20 OR row_number() OVER (PARTITION BY file, line, message ORDER BY rule_ord) = 1)""",
            _density("final"), """
results AS MATERIALIZED (
  SELECT f.path AS file, f.language, line_count, line_count > 20 AS big_file, d.n_findings, d.risk_score,
         array_to_string(sources, ',') AS sources, array_to_string(sinks, ',') AS sinks, complexity,
         CASE WHEN line_count > 20 THEN narrative ELSE 'Summary unavailable.' END AS summary
  FROM features f JOIN density d ON d.file = f.path JOIN sizes z ON z.path = f.path LEFT JOIN narrated t ON t.path = f.path)"""]


def _file_results() -> str:
    return _with(*_audit()) + "SELECT * FROM results"


def _project_map() -> str:
    bar, rule, top = "=" * 65, "─" * 63, -2**40
    heading = lambda n, title: (
        f"SELECT {n}, '', {top}, '', chr(10) || '  {rule}' || chr(10) || '  {title}' || chr(10) || '  {rule}'")
    shown = _display("severity")
    rows = [
        f"SELECT 0 AS section, '' AS first, 0::BIGINT AS second, '' AS third, "
        f"'{bar}' || chr(10) || '  PROJECT-LEVEL SECURITY MAP' || chr(10) || '  Directory : ' AS text",
        "SELECT 0, '', 1, '', '  Files     : ' || count(*) FROM results", f"SELECT 0, '', 2, '', '{bar}'",
        heading(1, "PROJECT OVERVIEW"),
        "SELECT 1, '', 0, '', 'Project contains ' || count(*) || ' source file(s) across ' || count(DISTINCT folder) "
        "|| ' component(s):' FROM entries",
        "SELECT 2, folder, 0, '', chr(10) || '  [' || folder || ']  (' || count(*) || ' file(s))' FROM entries GROUP BY folder",
        "SELECT 2, folder, 1, file, '    * ' || CASE WHEN length(entry) > 72 THEN substring(entry, 1, 69) || '...' "
        "ELSE entry END FROM entries",
        heading(3, "SECURITY STATS"), "SELECT 3, '', 0, '', '  Total Issues : ' || count(*) FROM final",
        *[f"SELECT 3, '', {n}, '', '    {label} Vulnerability{space} : ' || count(*) FILTER (WHERE {shown} = '{label.upper()}') FROM final"
          for n, label, space in ((1, "High", "  "), (2, "Medium", ""), (3, "Low", "   "))],
        heading(4, "TOP RISKIEST FILES"),
        f"SELECT 4, '', CAST(trunc(-risk_score * 10) AS BIGINT), file, '  [' || rpad({_label('risk_score')}, 8, ' ') || '] ' || "
        "printf('%4.1f', risk_score) || '/10  ' || file || '  (' || n_findings || ' finding(s))' "
        "FROM (SELECT * FROM results ORDER BY risk_score DESC, file LIMIT 5)",
        heading(5, "MOST COMMON VULNERABILITY TYPES"),
        "SELECT 5, '', rank, '', '  ' || rank || '. ' || rpad(category, CAST(greatest(28, length(category)) AS INTEGER), ' ') "
        "|| ' — ' || n_findings || ' occurrence(s)' FROM ranked WHERE rank <= 10",
        heading(6, "CROSS-FILE VULNERABILITY PATTERNS"),
        "SELECT 6, '', -n_files, check_id, '  ' || check_id FROM crossing",
        "SELECT DISTINCT 6, '', -n_files, check_id || chr(9) || file, '     → ' || file FROM crossing JOIN final USING (check_id)",
        heading(7, "PER-FILE AI SUMMARIES"),
        f"SELECT 7, file, -3, '', chr(10) || '  ' || file || '  [' || {_label('risk_score')} || '  ' || printf('%.1f', risk_score) "
        "|| '/10]' || CASE WHEN big_file THEN '  [BIG-FILE]' ELSE '' END FROM results",
        "SELECT 7, file, -2, '', '  ' || summary FROM results",
        "SELECT 7, file, -1, '', '    Vulnerabilities (' || n_findings || '):' FROM results WHERE n_findings > 0",
        f"SELECT 7, file, line, printf('%05d', rule_ord), {_row('    ', chr(39) * 2)} FROM final",
        f"SELECT 9, '', 0, '', chr(10) || '{bar}' || chr(10)",
    ]
    return _with(*_audit(), f"""
entries AS (
  SELECT string_split(file, '/')[1] AS folder, file, string_split(file, '/')[-1] || ' — ' || summary AS entry FROM results),
ranked AS (
  SELECT row_number() OVER (ORDER BY count(*) DESC, min((file, rule_ord, line))) AS rank,
         {_category('message')} AS category, count(*) AS n_findings
  FROM final GROUP BY {_category('message')}),
crossing AS (
  SELECT check_id, count(DISTINCT file) AS n_files FROM final GROUP BY check_id HAVING count(DISTINCT file) >= 2
  ORDER BY n_files DESC, min((file, rule_ord, line)) LIMIT 10)""") + "\nUNION ALL ".join(rows)


def _merged_results() -> str:
    return (_with(*_found(), *_bounds(60), _TAGGED, f"""
big AS (SELECT path, {_NEWLINES} > 20 AS big_file FROM code_files),
first_pass AS (
  SELECT * FROM found WHERE severity = 'ERROR'
  UNION ALL SELECT * FROM found WHERE file NOT IN (SELECT file FROM found WHERE severity = 'ERROR')),
merged AS (
  SELECT DISTINCT file, line, message, severity FROM (
    SELECT file, line, message, severity FROM first_pass
    UNION ALL SELECT file, line, message, severity FROM tagged)
  WHERE file IN (SELECT path FROM big WHERE big_file)
  UNION ALL SELECT file, line, message, severity FROM first_pass
  WHERE file IN (SELECT path FROM big WHERE NOT big_file))""", _density("merged")) + """
SELECT d.file, big_file, n_findings, risk_score FROM density d JOIN big ON big.path = d.file""")


def _sequence() -> str:
    names = {r[0]: (r[1], r[5]) for r in RULE_FILE_C}
    free = r"\bfree[ \t]*\([ \t]*(\w+)[ \t]*\)"
    malloc = r"(\w+)[ \t]*=[ \t]*(?:\([^()]*\)[ \t]*)?malloc[ \t]*\("
    checks = [r"(\w+)[ \t]*[!=]=[ \t]*(?:NULL|0)\b", r"\b(?:NULL|0)[ \t]*[!=]=[ \t]*(\w+)", r"![ \t]*(\w+)",
              r"\bif[ \t]*\([ \t]*(\w+)[ \t]*[)&|]"]
    kinds = [("free", free), ("use", r"(\w+)[ \t]*->"), ("malloc", malloc)] + [("check", c) for c in checks]
    events = "\n  UNION ".join(
        f"SELECT path, block, line, raw, {q(kind)} AS kind, unnest(regexp_extract_all(code, {q(p)}, 1)) AS pointer "
        f"FROM c_lines" for kind, p in kinds)

    def found(rule_id, where):
        severity, message = names[rule_id]
        return (f"SELECT DISTINCT {q(rule_id)} AS check_id, path AS file, line, {q(message)} AS message, "
                f"{q(severity)} AS severity, substring({strip('raw')}, 1, 120) AS snippet FROM events e WHERE {where}")
    later = lambda kind: (f"(SELECT min(o.line) FROM events o WHERE o.path = e.path AND o.block = e.block "
                          f"AND o.pointer = e.pointer AND o.line > e.line AND o.kind = {q(kind)})")
    return (_with(_code_files(), _masked(), _code_lines(), _depths("c", "{", "}", "c_depth"), f"""
c_functions AS (
  SELECT s.path, s.line AS first, coalesce(min(e.line), 2147483647) AS last
  FROM c_depth s LEFT JOIN c_depth e ON e.path = s.path AND e.line >= s.line AND e.after <= 0
  WHERE s.before = 0 AND s.opened > 0 GROUP BY s.path, s.line),
c_lines AS (
  SELECT d.path, d.line, d.raw, d.code, f.first AS block
  FROM c_depth d JOIN c_functions f ON f.path = d.path AND d.line BETWEEN f.first AND f.last),
events AS ({events})""")
            + found("c-double-free", f"kind = 'free' AND {later('free')} IS NOT NULL")
            + "\nUNION ALL " + found("c-use-after-free", f"kind = 'free' AND {later('use')} IS NOT NULL")
            + "\nUNION ALL " + found(
                "c-null-deref-no-check",
                f"kind = 'malloc' AND {later('use')} < coalesce({later('check')}, 2147483647)"))


def all_sql() -> dict[str, str]:
    rules = catalog.line_rules()
    file_rules = catalog.rule_file_rules()
    code = [_code_files(), _lines("code_files", "lines")]
    by_file_rule = _scan("matched", file_rules)
    sql = {}

    sql["scan_secrets"] = _with(
        """
prose AS (
  SELECT source || '/f' || doc_id || ext AS path, text AS content, language
  FROM documents, (VALUES ('javascript', '.js'), ('java', '.java')) AS t(language, ext))""",
        _lines("prose", "lines"),
        _scan("found", rules, only=("fallback.js.secrets-hardcoded", "fallback.java.secrets-password"))
    ) + f"SELECT {_FINDING} FROM found"
    sql["scan_all_rules"] = _over_found(f"SELECT {_FINDING} FROM found")
    sql["scan_rule_file"] = (_with(*code, by_file_rule)
                             + "SELECT DISTINCT check_id, file, line, message, severity FROM matched")
    user = [catalog.Rule(i, language, s, m, p) for i, language, _, s, m, p in USER_RULES]
    sql["scan_rule_table"] = _with(*code, _scan("found", user)) + f"""
SELECT {_FINDING} FROM found QUALIFY row_number() OVER (PARTITION BY check_id, file, line ORDER BY rule_ord) = 1"""
    sql["scan_many_rules"] = _with(*code, _scan("found", user)) + f"""
SELECT check_id, file, line, severity FROM found
QUALIFY row_number() OVER (PARTITION BY check_id, file, line ORDER BY rule_ord) = 1
UNION ALL
SELECT DISTINCT 'word.' || w, path, line, 'INFO'
FROM (SELECT path, line, language, unnest(regexp_extract_all(text, '{_W}+')) AS word FROM lines)
JOIN (SELECT DISTINCT unnest(regexp_extract_all(text, '{_W}{{4,}}')) AS w FROM benchmark)
ON CASE WHEN language = 'java' THEN lower(word) = lower(w) ELSE word = w END"""
    chosen = [r for r in file_rules if r.exclude]
    plain = [catalog.Rule(r.rule_id, r.language, r.severity, r.message, r.pattern) for r in chosen]
    guarded = f"""
guarded_files AS (
  SELECT path, language, content || chr(10) || {_pick(corpus.GUARDED, "((CAST(regexp_extract(path, '/f([0-9]+)', 1) AS BIGINT) // 4) % 4)")} AS content
  FROM code_files)"""
    sql["pattern_and_not"] = _with(_code_files(), guarded, _lines("guarded_files", "lines"),
                                   _scan("plain", plain), _scan("kept", chosen)) + """
SELECT check_id, n_plain, coalesce(n_kept, 0) AS n_kept
FROM (SELECT check_id, count(*) AS n_plain FROM (SELECT DISTINCT check_id, file, line FROM plain) GROUP BY check_id)
LEFT JOIN (SELECT check_id, count(*) AS n_kept FROM (SELECT DISTINCT check_id, file, line FROM kept) GROUP BY check_id)
USING (check_id)"""
    sql["scan_html_lines"] = _with("""
code_files AS (
  SELECT CAST(page_id AS VARCHAR) AS path, 'javascript' AS language,
         array_to_string(regexp_extract_all(html, '<script[^>]*>([\\s\\S]*?)</script>', 1), chr(10)) AS content
  FROM pages)""", _masked()) + f"""
SELECT path, call, count(*) AS n_calls
FROM (SELECT path, unnest(regexp_extract_all(code, {q(_CALL)}, 1)) AS call FROM masked) GROUP BY path, call"""
    coverage = "\n  UNION ALL ".join(
        f"SELECT {q(r[0])} AS check_id, {q(r[1])} AS severity, {q(r[3])} AS kind, {q(r[2])} AS cwe, {q(language)} AS language"
        for language, rows in (("python", RULE_FILE_PYTHON), ("c", RULE_FILE_C), ("java", RULE_FILE_JAVA),
                               ("javascript", RULE_FILE_JAVASCRIPT)) for r in rows)
    sql["rule_coverage"] = _with(*code, by_file_rule, f"""
catalogue AS ({coverage}),
hits AS (SELECT check_id, count(*) AS n FROM (SELECT DISTINCT check_id, file, line FROM matched) GROUP BY check_id)""") + """
SELECT check_id, severity, kind, cwe, language, coalesce(n, 0) AS n_findings FROM catalogue LEFT JOIN hits USING (check_id)"""
    sql["sequence_rules"] = _sequence()
    sql["call_rules"] = _with(_code_files(), _spread_calls()) + f"""
SELECT check_id, file, line, CAST(line + length(call) - length(replace(call, chr(10), '')) AS INTEGER) AS last_line, message, severity,
       substring(regexp_replace(call, '{_S}+', ' ', 'g'), 1, {lookups.SCAN_SNIPPET_CHARS}) AS snippet
FROM hits WHERE contains(call, chr(10))"""
    # The same rows as with NOT EXISTS over a second scan of all files, which this engine works out for each row.
    sql["fallback_when_empty"] = _over_found(f"""
SELECT {_FINDING} FROM (SELECT *, bool_or(severity = 'ERROR') OVER (PARTITION BY file) AS covered FROM found)
WHERE severity = 'ERROR' OR NOT covered""")
    sql["json_findings"] = sql["scan_all_rules"]
    sql["bulk_json_findings"] = _over_found("""
SELECT language, check_id, path AS file, CASE WHEN severity = 'INFO' THEN 0 ELSE line END AS line,
       CASE WHEN severity = 'INFO' THEN '' ELSE message END AS message, severity, snippet
FROM code_files LEFT JOIN found ON path = file""")

    both = """
both_messages AS (
  SELECT check_id, file, line, severity, message FROM found
  UNION ALL SELECT check_id, file, line, severity, regexp_replace(message, '^\\[[^\\]]*\\] ', '') FROM found)"""
    sql["classify_messages"] = _over_found(f"""
SELECT check_id, file, line, message, {_weakness('message')} AS weakness, {_category('message')} AS category,
       {_display('severity')} AS display_severity, {_short('message')} AS short FROM both_messages""", both)
    sql["classify_lines"] = _with(_lines("documents", "lines", "doc_id", "text").replace(
        "SELECT doc_id, CAST", "SELECT doc_id, CAST")) + f"""
SELECT {_category('text')} AS category, count(*) AS n_lines FROM lines GROUP BY 1"""
    sql["category_join"] = _over_found(f"""
SELECT {_weakness('message')} AS weakness,
       {_case(_weakness('message'), lookups.WEAKNESS_CATEGORY.items(), "'Other'")} AS category, count(*) AS n_findings
FROM found GROUP BY 1, 2""")
    sql["dedup_findings"] = _over_found(_distinct("doubled", "origin, rule_ord", _FINDING), """
doubled AS (
  SELECT *, 0 AS origin FROM found
  UNION ALL SELECT * REPLACE ('copy.' || check_id AS check_id), 1 AS origin FROM found)""")
    sql["new_findings"] = _over_found(f"SELECT {_FINDING} FROM found WHERE severity <> 'ERROR'")
    risk = "coalesce(risk_score, 0.0)"
    sql["risk_severity_first"] = _over_found(f"""
SELECT path AS file, coalesce(n_findings, 0) AS n_findings, {risk} AS risk_score, {_label(risk)} AS label,
       CASE WHEN {risk} >= 8 THEN 'HIGH' WHEN {risk} >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS panel,
       CAST(trunc({risk} / 10.0 * 100) AS INTEGER) AS gauge
FROM code_files LEFT JOIN scored ON path = file""", _SCORED)
    sql["risk_density"] = _over_found("SELECT file, reader_lines, n_findings, risk_score FROM density", _density())
    sql["severity_counts"] = _over_found(f"""
SELECT {_display('severity')} AS severity, count(*) AS n_findings FROM found GROUP BY 1""")
    sql["dashboard_counts"] = _over_found("""
SELECT count(*) FILTER (WHERE line >= 5 AND severity = 'ERROR') AS high,
       count(*) FILTER (WHERE line >= 5 AND severity = 'WARNING') AS medium,
       count(*) FILTER (WHERE line < 5 OR severity = 'INFO') AS low, count(*) AS total FROM found""")
    ranked = f"""
ranked AS (
  SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, min((file, rule_ord, line))) AS INTEGER) AS rank,
         {_category('message')} AS category, count(*) AS n_findings
  FROM found GROUP BY {_category('message')})"""
    sql["category_counts"] = _over_found("SELECT rank, category, n_findings FROM ranked", ranked)
    sql["top_categories"] = _over_found("SELECT rank, category, n_findings FROM ranked WHERE rank <= 10", ranked)
    sql["cross_file_rules"] = _over_found("""
SELECT DISTINCT check_id, file, n_files FROM found JOIN (
  SELECT check_id, count(DISTINCT file) AS n_files FROM found GROUP BY check_id HAVING count(DISTINCT file) >= 2
  ORDER BY n_files DESC, min((file, rule_ord, line)) LIMIT 10) USING (check_id)""")
    sql["top_risky_files"] = _over_found(f"""
SELECT file, n_findings, risk_score, {_label('risk_score')} AS label FROM scored
ORDER BY risk_score DESC, file LIMIT 5""", _SCORED)
    sql["top_secret_documents"] = (
        sql["scan_secrets"].rsplit("SELECT", 1)[0].rstrip() + "," + _SCORED
        + "\nSELECT file, n_findings, risk_score FROM scored ORDER BY risk_score DESC, file LIMIT 5")
    sql["finding_snippets"] = _over_found(f"""
SELECT check_id, file, f.line, coalesce(substring({strip('l.text')}, 1, 100), '') AS source_line
FROM (SELECT check_id, file, line + CASE WHEN severity = 'INFO' THEN 500 ELSE 0 END AS line FROM found) f
LEFT JOIN reader_lines l ON l.path = f.file AND l.line = f.line""", _lines("code_files", "reader_lines", breaks=r"\r\n?"))
    tail = "CASE WHEN severity = 'ERROR' THEN '  (chunk: part_' || line || ')' ELSE '' END"
    sql["finding_rows"] = _over_found(f"""
SELECT file, line, check_id, {_row('  ', tail)} AS row,
       '[' || {_display('severity')} || '] Line ' || line || ' -- ' || {_category('message')} || {_TAG} || ': ' ||
       substring(message, 1, 70) AS chunk_row
FROM found""")

    sql["line_counts"] = _with(_code_files()) + f"""
SELECT path, {_NEWLINES} AS line_count, {_READER_LINES} AS reader_lines FROM code_files"""
    sql["language_map"] = _with(_code_files()) + """
SELECT string_split(p, '/')[1] AS folder, language, count(*) AS n_files, max(string_split(p, '/')[-1]) AS last_name
FROM (SELECT path AS p, language FROM code_files UNION ALL SELECT upper(path), language FROM code_files) GROUP BY 1, 2"""
    sql["pruned_paths"] = _with(_code_files()) + """
SELECT path FROM (SELECT '/repo/' || folder || path AS path
                  FROM code_files, (VALUES (''), ('src/_gen/'), ('targets/')) AS t(folder))"""
    sql["line_windows"] = _with(
        "\nplain AS (SELECT source || '/f' || doc_id AS path, '' AS language, text AS content FROM documents)",
        _lines("plain", "lines"), _windows("windows", 10)) + """
SELECT path, chunk_id, name, start_line, text FROM windows"""
    sql["conversation_windows"] = """
SELECT conv_id, CAST(turn // 3 * 3 AS INTEGER) AS start_line, CAST(turn // 3 AS INTEGER) AS chunk_id,
       'lines_' || (turn // 3 * 3 + 1) || '_to_' || (turn // 3 * 3 + count(*)) AS name,
       string_agg(text, chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id, turn // 3"""
    results = f"""
results AS (
  SELECT source, source || '/f' || doc_id || '.txt' AS file, 'f' || doc_id || '.txt' AS name,
         {_clean_summary("string_split(text, chr(10))[1]")} AS summary FROM documents)"""
    sql["group_overview"] = _with(results) + """
SELECT source AS "group", file, CASE WHEN length(e) > 72 THEN substring(e, 1, 69) || '...' ELSE e END AS entry,
       count(*) OVER (PARTITION BY source) AS n_files
FROM (SELECT source, file, name || ' — ' || summary AS e FROM results WHERE summary <> '')"""
    sql["group_totals"] = _with(results) + """
SELECT count(*) AS n_files, count(DISTINCT source) AS n_groups FROM results WHERE summary <> ''"""
    opening = "(['summarize ', 'Summary for a single ', 'SUMMARY FOR ', ''])[turn % 4 + 1]"
    sql["summary_cleanup"] = f"""
SELECT conv_id, turn, {_clean_summary(f"{opening} || text || ' '")} AS summary FROM conversations"""

    sql["block_chunks"] = (_with(_code_files(), *_blocks())
                           + "SELECT path, chunk_id, name, start_line, end_line FROM blocks")
    sql["chunk_bounds"] = (_with(*code, *_bounds(10))
                           + "SELECT path, chunk_id, name, start_line, end_line FROM bounds")
    sql["segment_chunks"] = sql["chunk_bounds"]
    sql["chunk_findings"] = _over_found(
        "SELECT check_id, file, line, original_chunk, chunk_id FROM tagged", *_bounds(10), _TAGGED)
    sql["chunk_remap"] = _over_found(
        "SELECT check_id, file, line, original_chunk, chunk_id FROM tagged", _windows("bounds", 4), _TAGGED)
    sql["chunk_rollup"] = _over_found(f"""
SELECT path, count(*) AS n_chunks, CAST(sum(n_findings) AS BIGINT) AS n_findings, max(risk_score) AS top_score,
       count(*) FILTER (WHERE risk_score >= 4) AS n_risky, sum((end_line - start_line) * 0.5)::DOUBLE AS total_seconds,
       {_label('max(risk_score)')} AS label
FROM chunk_scored GROUP BY path""", _windows("windows", 4), _chunk_scores("windows"))
    part = _clean_summary("string_split(text, chr(10))[1]")
    sql["narrative"] = _over_found(_NARRATIVE, _windows("windows", 4), _chunk_scores("windows"), _told(part))

    listed = lambda c: f"array_to_string({c}, ',') AS {c}"
    featured = _with(_code_files(), _masked(), _features())
    sql["call_features"] = featured + f"SELECT path, language, {listed('sources')}, {listed('sinks')} FROM features"
    sql["complexity"] = featured + "SELECT path, complexity FROM features"
    quoted = lambda c: (f"'[' || array_to_string(list_transform({c}, lambda n: '\"' || n || '\"'), ',') || ']'")
    sql["feature_json"] = featured + f"""
SELECT path, '{{"sources":' || {quoted('sources')} || ',"sinks":' || {quoted('sinks')} || ',"complexity":' || complexity || '}}'
       AS features_json FROM features"""
    names = lambda c: (f"CASE WHEN len({c}) > 0 THEN array_to_string(list_sort(list_distinct({c})), ', ') ELSE 'none' END")
    start = "substring('// File: ' || string_split(path, '/')[-1] || chr(10) || content, 1, 450)"
    sql["prompt_text"] = _with(*_found(), _masked(), _features(), """
notes AS (
  SELECT file, string_agg(severity || ' - ' || message || ' (line ' || line || ')', '; ' ORDER BY rule_ord, line) AS notes
  FROM found GROUP BY file)""") + f"""
SELECT path, CASE WHEN notes IS NULL THEN {start}
  ELSE '/* sinks=' || {names('sinks')} || ' | sources=' || {names('sources')} || ' | complexity=' || complexity
       || ' | security_findings=' || notes || ' */' || chr(10) || {start} END AS prompt
FROM features LEFT JOIN notes ON path = file"""

    sql["file_results"] = _file_results()
    sql["nested_results"] = _with(*_audit(), """
listed AS (SELECT file, string_agg(check_id || ':' || line, ',' ORDER BY rule_ord, line, check_id) AS findings FROM final GROUP BY file)""") + """
SELECT file, language, line_count, big_file, risk_score, summary, sources, complexity, coalesce(findings, '') AS findings
FROM results LEFT JOIN listed USING (file)"""
    sql["byte_files"] = _over_found("""
SELECT path, n AS n_findings, CASE WHEN broken THEN NULL ELSE CAST(length(content) AS INTEGER) END AS n_chars,
       CASE WHEN broken THEN 'no such file' END AS error
FROM (SELECT *, CAST(regexp_extract(path, '/f([0-9]+)', 1) AS BIGINT) % 5 = 0 AS broken FROM code_files)
LEFT JOIN (SELECT file, count(*) AS n FROM found GROUP BY file) ON file = path AND NOT broken""")
    sql["folder_listing"] = _with(_code_files(), """
tree AS (
  SELECT CASE WHEN number % 7 = 0 THEN string_split(path, '/')[-1]
              ELSE (['', 'dist/', 'src/'])[number % 3 + 1] || path END AS path, language, CAST(length(content) AS INTEGER) AS n_chars
  FROM (SELECT *, CAST(regexp_extract(path, '/f([0-9]+)', 1) AS BIGINT) AS number FROM code_files))""") + """
SELECT mode, path, language, n_chars FROM tree, (VALUES ('pruned'), ('all'), ('flat')) AS t(mode)
WHERE mode = 'all' OR (mode = 'pruned' AND path NOT LIKE 'dist/%') OR (mode = 'flat' AND path NOT LIKE '%/%')"""
    sql["chunk_order"] = _over_found(f"""
SELECT c.path, c.chunk_id, c.name, c.start_line, c.end_line, c.n_findings, c.risk_score, complexity,
       array_to_string(sinks, ',') AS sinks, coalesce(lines, '') AS lines
FROM chunk_scored c JOIN features f ON f.path = c.path || '#' || c.chunk_id
LEFT JOIN (SELECT file, chunk_id, string_agg(CAST(line AS VARCHAR), ',' ORDER BY rule_ord, line, check_id) AS lines
           FROM tagged GROUP BY file, chunk_id) t ON t.file = c.path AND t.chunk_id = c.chunk_id""",
        *_bounds(10), _TAGGED, "\nwhole_bounds AS (SELECT *, '' AS text FROM bounds)", _chunk_scores("whole_bounds"), _CHUNK_TEXTS,
        _masked("chunk_files").replace("masked AS", "chunk_masked AS"), _features().replace("FROM masked", "FROM chunk_masked"))
    sql["chunk_text"] = _with(*code, *_bounds(10), _CHUNK_TEXTS) + "SELECT path, chunk_id, text FROM chunk_texts"
    sql["merged_results"] = _merged_results()
    sql["large_file_findings"] = _over_found(
        _distinct("tagged", "chunk_id, rule_ord, line", _FINDING + ", original_chunk, chunk_id"), *_bounds(10), _TAGGED)
    distinct = f"""
apart AS ({_distinct("tagged", "chunk_id, rule_ord, line", _FINDING + ", original_chunk, chunk_id, rule_ord")})"""
    row = _row("  ", "CASE WHEN original_chunk <> '' THEN '  (chunk: ' || original_chunk || ')' ELSE '' END")
    sql["large_file_table"] = _over_found(f"""
SELECT file, line, rule_ord, row || CASE WHEN shown <> '' THEN chr(10) || '{' ' * 16}|-- ' || shown ELSE '' END AS row
FROM (SELECT a.file, a.line, rule_ord, {row.replace("line", "a.line")} AS row,
             coalesce(substring({strip('l.text')}, 1, 100), '') AS shown
      FROM apart a LEFT JOIN reader_lines l ON l.path = a.file AND l.line = a.line)""",
        *_bounds(10), _TAGGED, distinct, _lines("code_files", "reader_lines", breaks=r"\r\n?"))
    sql["large_file_totals"] = _over_found(f"""
SELECT c.path, c.n_chunks, coalesce(n, 0) AS n_findings, top_score, n_risky, {_label('top_score')} AS label
FROM (SELECT path, count(*) AS n_chunks, max(risk_score) AS top_score, count(*) FILTER (WHERE risk_score >= 4) AS n_risky
      FROM chunk_scored GROUP BY path) c
LEFT JOIN (SELECT file, count(*) AS n FROM apart GROUP BY file) a ON a.file = c.path""",
        *_bounds(10), _TAGGED, distinct, "\nwhole_bounds AS (SELECT *, '' AS text FROM bounds)", _chunk_scores("whole_bounds"))
    sql["project_map"] = _project_map()
    sql["single_file_results"] = _with(*_found(), _masked(), _features(), _SCORED) + f"""
SELECT path, coalesce(n_findings, 0) AS n_findings, {risk} AS risk_score, {_label(risk)} AS label, complexity
FROM features LEFT JOIN scored ON path = file"""

    sql["metric_rollup"] = _report("counted", "true")
    sql["stream_rollup"] = sql["metric_rollup"]
    sql["modelled_energy"] = _report("modelled", "false")
    sql["counter_delta"] = _with(_READINGS) + "SELECT run_id, first_uj, last_uj, counted AS joules FROM joules"
    sql["counter_totals"] = _with(_READINGS) + """
SELECT run_id, at_us // 3600000000 AS hour, CAST(sum(rapl_energy_uj) AS BIGINT) AS rapl_energy_uj
FROM readings GROUP BY 1, 2"""
    sql["phase_durations"] = _with(_READINGS, """
spans AS (
  SELECT run_id, domain AS phase, lead(at_us) OVER (PARTITION BY run_id ORDER BY at_us, sample_id) - at_us AS us
  FROM readings),
durations AS (
  SELECT run_id, phase, coalesce(sum(us), 0) / 1000000.0 AS seconds FROM spans GROUP BY run_id, phase)""") + """
SELECT run_id, phase, round(seconds, 6) AS seconds,
       round(seconds / sum(seconds) OVER (PARTITION BY run_id) * 100, 1) AS wall_share,
       round(seconds / max(seconds) OVER (PARTITION BY run_id) * 100, 6) AS longest_share
FROM durations"""
    sql["elapsed_series"] = _with(_READINGS) + """
SELECT run_id, sample_id, round((at_us - min(at_us) OVER (PARTITION BY run_id)) / 1000000.0, 2) AS elapsed_s FROM readings"""
    sql["scalability_points"] = _with(_READINGS) + """
SELECT run_id, n_samples, round(avg_cpu_percent, 6) AS avg_cpu_percent, round(peak_memory_mb, 6) AS peak_memory_mb FROM rolled"""
    sql["report_validity"] = _with(_READINGS) + """
SELECT round(wall_time_s, 6) AS wall_time_s, round(peak_memory_mb, 6) AS peak_memory_mb, true AS rapl_supported,
       round(wall_time_s, 6) AS scan_s FROM rolled WHERE n_samples > 66"""
    return sql
