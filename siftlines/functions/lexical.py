"""Code as plain text: blanking out strings and comments, finding names.

Everything here is lexical.  Strings and comments are recognised by regular
expressions per language, so code that only a parser could tell apart (calls
inside an f-string, a regular-expression literal after a closing bracket) is
read the simple way.
"""

from pyspark.sql import Column, functions as F

from siftlines.functions import lookups
from siftlines.functions.text import NO_BOUNDARY, let, newlines

# Possessive, so that a string of any length and any number of escapes is matched without recursion.
_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_TRIPLE = r'"""[\s\S]*?"""' + r"|'''[\s\S]*?'''"
_TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
_SLASH_COMMENT = r"/\*[\s\S]*?\*/|//[^\n]*"
# A regular-expression literal: a slash where no value can have ended, up to the next one outside a class.
_REGEX = (r"(?<=(?:[(,=:\[!&|?{};\n]|\breturn)[ \t]{0,8})/(?![/*])"
          r"(?:[^/\\\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/[a-z]*+")

# Alternatives that cut a text into blanked pieces (tried first) and the rest.
PIECES = {
    "python": rf"{_TRIPLE}|{_DOUBLE}|{_SINGLE}|#[^\n]*|[^\"'#]+|[\s\S]",
    "javascript": rf"{_SLASH_COMMENT}|{_REGEX}|{_DOUBLE}|{_SINGLE}|{_TEMPLATE}|[^\"'`/]+|[\s\S]",
    "java": rf"{_SLASH_COMMENT}|{_DOUBLE}|{_SINGLE}|[^\"'/]+|[\s\S]",
    "c": rf"{_SLASH_COMMENT}|{_DOUBLE}|{_SINGLE}|[^\"'/]+|[\s\S]",
}

# A piece is blanked when it starts like this and is longer than its opening sign.
BLANKED = {
    "python": r"^(?:\"[^\n]*\"|'[^\n]*'|\"\"\"|'''|#)",
    "javascript": r"^(?:\"[^\n]*\"|'[^\n]*'|`[\s\S]*`|/\*|//|/[^\n]+/)",
    "java": r"^(?:\"[^\n]*\"|'[^\n]*'|/\*|//)",
    "c": r"^(?:\"[^\n]*\"|'[^\n]*'|/\*|//)",
}

_NAME = r"[\p{L}\p{N}_.]"
# Words right before a name that make it a declaration or a construction.
_DECLARING = r"(?:new|def|class|function|void|int|char|long|double|float|boolean|size_t|ssize_t|String)"

# A call: the dotted name right before a parenthesis, unless it is declared,
# constructed or reached through a pointer.  It is read backwards from its parenthesis,
# so that words without one cost nothing; marks count to the letter before them, not after.
_BACKWARDS = "|".join(word[::-1] for word in _DECLARING[3:-1].split("|"))
# Otherwise what follows the first character of the name beyond the basic plane is a call even so.
CALL = (rf"^\s*+({_NAME}++(?!>-)(?!\*{{0,3}}[ \t]{{1,4}}(?:{_BACKWARDS})(?:\b|(?=\p{{Mn}}++(?![\p{{L}}\p{{Nd}}]))))"
        rf"|{_NAME}+(?=[\x{{10000}}-\x{{10FFFF}}]))")

# Branching words and operators, by language; first what any of them begins with.
BRANCH = {
    "python": r"(?m)(?=[ \tiewfao])(?:^[ \t]*(?:if|elif|for|while|except|async[ \t]+for)\b|\b(?:and|or)\b)",
    "javascript": r"(?=[iwfc|&])(?:\b(?:if|while)[ \t]*\(|\bfor[ \t]*\([^;){\n]*;|\b(?:case|catch)\b|\|\||&&)",
    "java": r"(?=[iwfcd|&])(?:\b(?:if|while)[ \t]*\(|\bfor[ \t]*\([^;){\n]*;|\b(?:case|default|catch)\b|\|\||&&)",
    "c": r"(?=[iwfcd|&])(?:\b(?:if|while|for)[ \t]*\(|\b(?:case|default)\b|\|\||&&)",
}


def _by_language(language: Column, build) -> Column:
    chosen = F.lit(None)
    for name in PIECES:
        chosen = F.when(language == name, build(name)).otherwise(chosen)
    return chosen


def masked(content: Column, language: Column) -> Column:
    """Code without its strings and comments; every line keeps its number."""
    def mask(name):
        def blank(piece):
            return F.when(piece.rlike(BLANKED[name]), F.regexp_replace(piece, NO_BOUNDARY, "")).otherwise(piece)
        return F.array_join(F.transform(F.regexp_extract_all(newlines(content), F.lit(PIECES[name]), 0), blank), "")
    return _by_language(language, mask)


def calls(code: Column, language: Column) -> Column:
    """Names of all calls in masked code, in order, repeats kept."""
    def before(parts):
        names = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda part: F.reverse(F.regexp_extract(F.reverse(part), CALL, 1)))
        return F.filter(names, lambda name: name != "")
    found = let(F.split(code, r"\(", -1), before)
    # A Java method is called on something, but only its own name counts.
    return F.when(language == "java",
                  F.transform(found, lambda n: F.regexp_replace(n, r"^.*\.", ""))).otherwise(found)


def _listed(names: Column, language: Column, table: dict) -> Column:
    return let(names, lambda found: _by_language(language, lambda name: F.filter(
        found, lambda n: n.isin(*table[name]))))


def sources(names: Column, language: Column) -> Column:
    return _listed(names, language, lookups.SOURCES)


def sinks(names: Column, language: Column) -> Column:
    return _listed(names, language, lookups.SINKS)


# The word that opens a loop whose ``while`` comes last; that ``while`` is no branch of its own.
_DO = r"(?:^|[;{})\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]|\belse)[ \t]*do\b\s*(?=[{\p{L}_(+*-])"


def complexity(code: Column, language: Column) -> Column:
    """Number of branching constructs in masked code."""
    def count(name):
        branches = F.regexp_count(code, F.lit(BRANCH[name]))
        loops = F.when(F.contains(code, F.lit("do")), F.regexp_count(code, F.lit(_DO))).otherwise(0)
        return branches if name == "python" else F.greatest(F.lit(0), branches - loops)
    return F.coalesce(_by_language(language, count), F.lit(0))
