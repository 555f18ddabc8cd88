"""Patterns of calls: ``$X`` is any expression (the same one each time), ``...`` any number of arguments or any expression.

A call is matched in the shape that ``operators.calls`` gives it: the callee, an opening bracket, then every argument after
ARG, its tokens with blanks between them and a BINARY mark before operators that stand outside inner brackets.
"""

import re
from dataclasses import dataclass

ARG, BINARY = "\x1f", "\x1e"

# The rule file's patterns of calls, by language: id, patterns, patterns that must not match.
CALL_RULES = {
    "python": [
        ("python-sqli-string-concat", ["$DB.execute($QUERY + ...)"], ['$DB.execute("..." + "...")']),
        ("python-sqli-format-string", ['$DB.execute("..." % ...)', '$DB.execute(f"...")'], []),
        ("python-sqli-executemany", ["$DB.executemany($QUERY + ...)"], []),
        ("python-command-injection-shell-true", ["subprocess.Popen(..., shell=True, ...)"], []),
        ("python-command-injection-call", ["subprocess.call(..., shell=True, ...)"], []),
        ("python-command-injection-run", ["subprocess.run(..., shell=True, ...)"], []),
        ("python-path-traversal-open", ["open($PATH, ...)"], ['open("...", ...)']),
        ("python-path-traversal-os-path-join", ["os.path.join($BASE, $INPUT)"], ['os.path.join($BASE, "...")']),
        ("python-xxe-lxml-nodefend", ["lxml.etree.parse(...)"], ["lxml.etree.parse(..., parser=...)"]),
        ("python-ssrf-requests", ["requests.get($URL, ...)"], ['requests.get("...", ...)']),
        ("python-ssrf-urllib", ["urllib.request.urlopen($URL)"], ['urllib.request.urlopen("...")']),
        ("python-django-raw-sql", ["$MODEL.objects.raw($QUERY + ...)"], []),
        ("python-open-redirect", ["redirect($URL)"], ['redirect("...")']),
    ],
    "c": [
        ("c-strcpy-overflow", ["strcpy(...)"], []),
        ("c-sprintf-overflow", ["sprintf(...)"], []),
        ("c-memcpy-no-bounds", ["memcpy($DST, $SRC, $SIZE)"], ["memcpy($DST, $SRC, sizeof($DST))"]),
        ("c-memmove-no-bounds", ["memmove($DST, $SRC, $SIZE)"], []),
        ("c-system-injection", ["system(...)"], []),
        ("c-popen-injection", ["popen(...)"], []),
        ("c-execlp-injection", ["execlp(...)"], []),
        ("c-printf-format-string", ["printf($FMT)"], ['printf("...")']),
        ("c-fprintf-format-string", ["fprintf($FD, $FMT)"], ['fprintf($FD, "...")']),
        ("c-syslog-format-string", ["syslog($PRI, $FMT)"], ['syslog($PRI, "...")']),
        ("c-integer-overflow-malloc", ["malloc($A * $B)"], []),
    ],
    "javascript": [
        ("js-settimeout-string", ["setTimeout($CODE, ...)"],
         ["setTimeout(function() {...}, ...)", "setTimeout(() => {...}, ...)"]),
        ("js-setinterval-string", ["setInterval($CODE, ...)"],
         ["setInterval(function() {...}, ...)", "setInterval(() => {...}, ...)"]),
        ("js-sqli-query-concat", ['$DB.query("..." + $INPUT, ...)', "$DB.query(`...${$INPUT}...`, ...)"], []),
        ("js-command-injection-exec", ["child_process.exec($CMD, ...)"], ['child_process.exec("...", ...)']),
        ("js-ssrf-fetch", ["fetch($URL, ...)"], ['fetch("...", ...)']),
        ("js-ssrf-axios", ["axios.get($URL, ...)"], ['axios.get("...", ...)']),
    ],
}

_TOKEN = re.compile(r'\.\.\.|\$\w+|f?"[^"]*"|`[^`]*`|\w+|=>|->|\S')
_EXPRESSION = rf"[^{ARG}]+"


@dataclass(frozen=True)
class CallRule:
    """A call hits when one of ``patterns`` matches it whole and none of ``exclude`` does."""

    rule_id: str
    language: str
    severity: str
    message: str
    patterns: tuple[str, ...]
    exclude: tuple[str, ...] = ()


def _metavariable(token: str, bound: set, inside: str) -> str:
    name = token[1:].replace("_", "")
    if name in bound:
        return rf"\k<{name}>"
    bound.add(name)
    return f"(?<{name}>{inside})"


def _token(token: str, bound: set, depth: int) -> str:
    if token == "...":
        return f"[^{ARG}]*"
    if token.startswith("$"):
        return _metavariable(token, bound, rf"[^{ARG},]+" if depth else _EXPRESSION)
    if token.startswith("`"):
        return "`[^`]*" + (r"\$\{[^`]*`" if "${" in token else "`")
    if token in ('"..."', 'f"..."'):
        return token[:-4] + '[^"]*"'
    return (BINARY if token in ("+", "%", "*") and not depth else "") + re.escape(token)


def _argument(text: str, bound: set) -> str:
    out, depth = [], 0
    for token in _TOKEN.findall(text):
        depth -= token in ")]}"
        out.append(_token(token, bound, depth))
        depth += token in "([{"
    return " ".join(out)


def _arguments(text: str) -> list[str]:
    """Arguments of a pattern, cut at the commas outside inner brackets and strings."""
    out, depth = [""], 0
    for token in re.findall(r'"[^"]*"|`[^`]*`|\s+|[^"`\s]', text):
        depth += (token in "([{") - (token in ")]}")
        if token == "," and not depth:
            out.append("")
        else:
            out[-1] += token
    return [each.strip() for each in out if each.strip()]


def _callee(text: str) -> str:
    return text[:text.index("(")]


def shape_regex(pattern: str) -> str:
    """The regular expression of all calls, in their shape, that a pattern stands for."""
    bound: set = set()
    callee = _callee(pattern)
    parts = callee.split(".")
    named = [_metavariable(p, bound, r"[^(]+" if i == 0 else r"\w+") if p.startswith("$") else re.escape(p)
             for i, p in enumerate(parts)]
    arguments = "".join(rf"(?:{ARG}{_EXPRESSION})*" if each == "..." else ARG + _argument(each, bound)
                        for each in _arguments(pattern[len(callee) + 1:-1]))
    return "^" + r"\.".join(named) + r"\(" + arguments + "$"


def wanted_names(rules: list[CallRule]) -> set[str]:
    """A name for each pattern that the callee of every match begins or ends with."""
    names = set()
    for rule in rules:
        for pattern in rule.patterns:
            parts = _callee(pattern).split(".")
            plain = [p for p in (parts[-1], parts[0]) if not p.startswith("$")]
            if not plain:
                raise ValueError(f"a pattern's callee must begin or end with a name: {pattern}")
            names.add(plain[0])
    return names
