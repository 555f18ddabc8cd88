"""String expressions with the text semantics the findings depend on."""

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from siftlines.functions import lookups

# What a Unicode-aware ``str.strip`` removes and ``\s`` matches.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")

_WORD = r"[\p{L}\p{N}_]"
_SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
_BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


_CLASSES = {
    "w": _WORD, "W": r"[^\p{L}\p{N}_]", "s": _SPACE, "S": r"[^\t-\r\x1c-\x1f\x85\p{Z}]", "d": r"\p{Nd}", "D": r"\P{Nd}",
    "b": _BOUNDARY, "B": rf"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))",
}


def unicode_regex(pattern: str) -> str:
    """Spell ``\\w``, ``\\s``, ``\\d``, ``\\b`` and their opposites out so that they cover Unicode.

    Rule patterns are written for a dialect in which these classes are Unicode
    ones; in Java they are ASCII, and ``(?U)`` draws slightly different borders
    (it leaves out superscript digits and adds combining marks).  An escaped
    backslash before such a letter is no class.
    """
    def spelled(m):
        if m[1] == "b":  # next to a letter of the pattern only the other side is open, and the letter is quicker to look for
            after, before = pattern[m.end():m.end() + 2], pattern[max(m.start() - 2, 0):m.start()]
            if re.match(r"[A-Za-z0-9_](?![?*{])", after):
                return f"(?={after[0]})(?<!{_WORD})"
            if re.search(r"(?<!\\)[A-Za-z0-9_]\Z", before):
                return f"(?!{_WORD})"
        return _CLASSES.get(m[1], m[0])

    return re.sub(r"\\(.)", spelled, pattern, flags=re.DOTALL).replace("(?P<", "(?<")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def snippet(text: Column, limit: int) -> Column:
    return F.substring(strip(text), 1, limit)


def truncate(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last three of them dots."""
    return F.when(F.char_length(text) > limit,
                  F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def newlines(content: Column) -> Column:
    """Universal newlines: ``\\r\\n`` and a lone ``\\r`` become ``\\n``."""
    return F.when(F.contains(content, F.lit("\r")),
                  F.regexp_replace(content, r"\r\n?", "\n")).otherwise(content)


# Line boundaries besides the newline.  Looking for them byte-wise first is
# much cheaper than running a replacing regex over every file.
_BOUNDARIES = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")


# A run of characters none of which ends a line.
NO_BOUNDARY = r"[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+"


def _plain_boundaries(content: Column) -> Column:
    def plain(c):
        has_other = reduce(or_, [F.contains(c, F.lit(mark)) for mark in _BOUNDARIES])
        return F.when(has_other, F.regexp_replace(c, r"\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")).otherwise(c)
    # Masked code is no column, and would be worked out again for every mark that is looked for.
    return let(content, plain)


def plain_lines(marked: Column) -> Column:
    """Split at newlines; a final newline does not open another line."""
    return let(marked, lambda m: F.when(m == "", F.array().cast("array<string>")).otherwise(
        F.split(F.when(F.endswith(m, F.lit("\n")), F.left(m, F.char_length(m) - 1)).otherwise(m), "\n")))


def split_lines(content: Column) -> Column:
    """Lines as a scan sees them: every Unicode line boundary ends a line."""
    return plain_lines(_plain_boundaries(content))


def read_lines(content: Column) -> Column:
    """Lines as a file reader sees them: only newlines end a line."""
    return plain_lines(newlines(content))


def newline_count(content: Column) -> Column:
    """Number of newlines plus one; one more than ``read_lines`` on a final newline."""
    text = newlines(content)
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def reader_line_count(content: Column) -> Column:
    """Number of lines a reader yields; a fixed number for an unreadable file."""
    return F.coalesce(
        F.when(content == "", 0).otherwise(
            newline_count(content) - F.when(newlines(content).endswith("\n"), 1).otherwise(0)),
        F.lit(lookups.UNREADABLE_LINE_COUNT)).cast("int")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"^(?:.*/)?\.*[^./][^/]*(\.[^./]*)\z", 1))


def language_of(path: Column) -> Column:
    """Language by extension, null when the extension is not supported."""
    ext = extension(path)
    chosen = F.lit(None).cast("string")
    for suffix, language in lookups.LANGUAGES.items():
        chosen = F.when(ext == suffix, language).otherwise(chosen)
    return chosen


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_path(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 2**31 - 1)).otherwise(path)


def top_folder(path: Column) -> Column:
    """First segment of a relative path, ``root`` when it has no folder."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("root"))


def make_text(raw: Column) -> Column:
    """Decode UTF-8 bytes and drop the ones that are not valid; a replacement sign that is there stays.

    In a text with invalid bytes a sign that is there is set aside as two noncharacters, which text does not hold.
    """
    plain = raw.cast("string")
    apart = F.replace(plain, F.lit("\ufffd"), F.lit("\U0010ffff\U0010fffe"))
    cleaned = F.replace(F.replace(F.make_valid_utf8(apart), F.lit("\ufffd"), F.lit("")),
                        F.lit("\U0010ffff\U0010fffe"), F.lit("\ufffd"))
    return F.when(F.is_valid_utf8(plain), plain).otherwise(cleaned)
