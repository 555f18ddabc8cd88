"""Code blocks: the named line ranges a file is cut into.

Blocks are found by one fold over a file's own line array.  The fold carries
the bracket depth and the block that is open; nothing is shuffled, and the
corpus is read once for all languages.
"""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from siftlines.functions import lexical, lookups
from siftlines.functions.text import let, split_lines

_PY_HEADER = r"^(?:async[ \t]+def|def|class)[ \t]+(\w+)"
_JS_FUNCTION = r"^[ \t]*(?:async[ \t]+)?function[ \t]+(\w+)"
_JS_CLASS = r"^[ \t]*class[ \t]+(\w+)"
# fixed values: router objects and methods that make a route
_JS_ROUTE = r"^[ \t]*(?:app|router|express)\.(get|post|put|delete|patch|use|route)[ \t]*\("
_JS_ROUTE_ARG = r"\([ \t]*([\"'][^\"'\n]*[\"']|`[^`\n]*`|[\w.]+(?:\([^()\n]*\))?)"
_JAVA_METHOD = (r"^[ \t]*(?:@\w+(?:\([^)]*\))?[ \t]+)*"
                r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*"
                r"(?:<[^<>]*>[ \t]*)?([\w.]+)(?:<[^()]*>)?(?:\[\])*[ \t]+(\w+)[ \t]*\(")
# Words that cannot be the type or the name of a method.
_JAVA_WORDS = ("new", "return", "else", "throw", "case", "package", "import", "class", "interface", "enum",
               "if", "for", "while", "switch", "catch", "try", "do", "synchronized", "assert", "instanceof")

_BLOCK = "struct<name:string,first:int,last:int>"
_BLOCKS = f"array<{_BLOCK}>"
_CHUNKS = "array<struct<chunk_id:int,name:string,start_line:int,end_line:int>>"


def _block(name: Column, first: Column, last: Column) -> Column:
    return F.struct(name.cast("string").alias("name"), first.cast("int").alias("first"), last.cast("int").alias("last"))


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _append(out: Column, condition: Column, block: Column) -> Column:
    return F.when(condition, F.concat(out, F.array(block))).otherwise(out)


def _count(code: Column, signs: str) -> Column:
    # Signs are looked for as bytes, one after the other: translate() looks up every character of a long line.
    rest = code
    for sign in signs:
        rest = F.replace(rest, F.lit(sign), F.lit(""))
    return F.octet_length(code) - F.octet_length(rest)


def _named(code: Column, word: str, pattern: str, group: int = 1) -> Column:
    """The name a header pattern captures; only lines with ``word`` are matched."""
    found = F.regexp_extract(code, pattern, group)
    return F.when(F.contains(code, F.lit(word)) & (found != ""), found)


def _state(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _empty() -> Column:
    return F.array().cast(_BLOCKS)


class Machine(NamedTuple):
    """How the blocks of a language are found.

    ``describe(code, raw)`` gives the fields of a line, ``relevant(item)`` says whether a line matters, ``step`` takes the state
    over such a line, and ``finish(state, last)`` gets the last filled line and gives the blocks with those still open.
    The state is ``start`` plus ``out``, the blocks found.
    """
    describe: Callable
    relevant: Callable
    start: dict
    step: Callable
    finish: Callable


def relevant_items(pairs: Column, machine: Machine) -> Column:
    """Struct of ``items``, the lines that matter with their number and that of the filled line above (0: none), and ``last``,
    the number of the last filled line (0: none)."""
    def item(filled):
        def build(x, at):
            above = F.when(at > 0, F.get(filled, at - 1)["line"]).otherwise(0)
            return F.struct(x["line"].alias("line"), above.alias("above"), *machine.describe(x["code"], x["raw"]))
        return build

    def over(filled):
        last = F.coalesce(F.get(filled, F.size(filled) - 1)["line"], F.lit(0))
        return F.struct(F.filter(F.transform(filled, item(filled)), machine.relevant).alias("items"), last.alias("last"))

    numbered = F.transform(pairs, lambda p, at: F.struct(
        (at + 1).alias("line"), p["code"].alias("code"), p["raw"].alias("raw")))
    return let(F.filter(numbered, lambda x: x["code"].rlike(r"[^ \t]")), over)


def fold_items(items: Column, machine: Machine, start: dict, finish) -> Column:
    """``finish(found, state)`` after the items: the blocks put aside so far, and the state with those after them.

    A fold copies its state at every step, so the lines are taken in about as
    many slices as a slice has lines, and the blocks of a slice are put aside
    at its end.
    """
    length = F.ceil(F.sqrt(F.size(items))).cast("int")
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), length)).otherwise(
        F.array().cast("array<int>"))

    def put_aside(whole):
        return lambda state: F.struct(
            _state(**{name: state[name] for name in start}, out=_empty()).alias("state"),
            F.concat(whole["found"], F.array(state["out"])).alias("found"))

    return F.aggregate(
        starts, F.struct(_state(**start, out=_empty()).alias("state"),
                         F.array().cast(f"array<{_BLOCKS}>").alias("found")),
        lambda whole, at: let(F.aggregate(F.slice(items, at, length), whole["state"], machine.step), put_aside(whole)),
        lambda whole: finish(F.flatten(whole["found"]), whole["state"]))


def _fold(pairs: Column, machine: Machine) -> Column:
    """Fold over the relevant ones of a file's filled lines."""
    return let(relevant_items(pairs, machine), lambda x: fold_items(
        x["items"], machine, machine.start, lambda found, state: F.concat(found, machine.finish(state, x["last"]))))


def _python() -> Machine:
    """Top-level functions and classes, decorators included."""
    def describe(c, raw):
        header = F.when(c.startswith("def") | c.startswith("class") | c.startswith("async"),
                        F.nullif(F.regexp_extract(c, _PY_HEADER, 1), F.lit("")))
        # A closing bracket in the first column continues the statement above it.
        return [c.rlike(r"^[^ \t)\]}]").alias("top"), c.startswith("@").alias("decorator"), header.alias("name")]

    def closed(s, last):
        return _append(s["out"], s["name"].isNotNull(), _block(s["name"], s["first"], last))

    def step(s, x):
        opens = ~s["decorated"]
        return _state(
            name=F.when(opens, x["name"]).otherwise(F.coalesce(s["name"], x["name"])),
            first=F.when(opens, x["line"]).otherwise(s["first"]),
            decorated=x["decorator"],
            out=F.when(opens, closed(s, x["above"])).otherwise(s["out"]))

    start = dict(name=_none(), first=F.lit(0), decorated=F.lit(False))
    return Machine(describe, lambda x: x["top"], start, step, closed)


def _brackets(code: Column, opening: str, closing: str) -> list[Column]:
    return [_count(code, opening).alias("opened"), _count(code, closing).alias("closed"),
            F.contains(code, F.lit("}")).alias("curly")]


def _ends(x: Column, after: Column, before: Column, level: Column) -> Column:
    """True when a line closes the bracket level a block was opened on."""
    return (x["closed"] > 0) & (after <= level) & (F.greatest(after, before - 1) >= level)


def _open_to_last(s: Column, last: Column) -> Column:
    return _append(s["out"], s["name"].isNotNull(), _block(s["name"], s["first"], last))


def _javascript() -> Machine:
    """Top-level functions, classes and routes."""
    def describe(c, raw):
        argument = F.regexp_extract(raw, _JS_ROUTE_ARG, 1)
        method = F.regexp_extract(c, _JS_ROUTE, 1)
        route = F.when(F.contains(c, F.lit("(")) & (method != "") & (argument != ""),
                       F.concat(F.lit("route_"), method, F.lit("_"), F.btrim(argument, F.lit("'\""))))
        block = F.coalesce(_named(c, "function", _JS_FUNCTION), _named(c, "class", _JS_CLASS))
        return [*_brackets(c, "{([", "})]"), F.coalesce(block, route).alias("name"), block.isNotNull().alias("body")]

    def step(s, x):
        before, after = s["depth"], s["depth"] + x["opened"] - x["closed"]
        header = (before == 0) & x["name"].isNotNull()
        # A header that meets the next header had no body: it is one line.
        lost = header & s["name"].isNotNull()
        name = F.when(header, x["name"]).otherwise(s["name"])
        first = F.when(header, x["line"]).otherwise(s["first"])
        body = F.when(header, x["body"]).otherwise(s["body"])
        ended = name.isNotNull() & _ends(x, after, before, F.lit(0)) & (~body | x["curly"])
        kept = _append(s["out"], lost, _block(s["name"], s["first"], s["first"]))
        return _state(depth=after.cast("int"), name=F.when(~ended, name), first=first, body=body,
                      out=_append(kept, ended, _block(name, first, x["line"])))

    start = dict(depth=F.lit(0), name=_none(), first=F.lit(0), body=F.lit(False))
    return Machine(describe, lambda x: (x["opened"] + x["closed"] > 0) | x["name"].isNotNull(),
                   start, step, _open_to_last)


def _java() -> Machine:
    """Methods at any depth, but none inside another method."""
    def describe(c, raw):
        kind, name = F.regexp_extract(c, _JAVA_METHOD, 1), F.regexp_extract(c, _JAVA_METHOD, 2)
        method = (name != "") & ~kind.isin(*_JAVA_WORDS) & ~name.isin(*_JAVA_WORDS)
        return [*_brackets(c, "{", "}"), F.when(F.contains(c, F.lit("(")) & method, name).alias("name"),
                (F.contains(c, F.lit("@")) & c.rlike(r"^[ \t]*@\w+(?:\([^)]*\))?[ \t]*$")).alias("annotation"),
                (F.endswith(F.rtrim(c, F.lit(" \t")), F.lit(";")) & ~F.contains(c, F.lit("{"))).alias("bodyless")]

    def step(s, x):
        before, after = s["depth"], s["depth"] + x["opened"] - x["closed"]
        header = s["name"].isNull() & x["name"].isNotNull()
        # Annotation lines right above a method belong to it.
        joined = F.when(s["noted_to"] == x["above"], s["noted"])
        name = F.when(header, x["name"]).otherwise(s["name"])
        first = F.when(header, F.coalesce(joined, x["line"])).otherwise(s["first"])
        level = F.when(header, before).otherwise(s["level"])
        ended = name.isNotNull() & ((header & x["bodyless"]) | _ends(x, after, before, level))
        return _state(depth=after.cast("int"), name=F.when(~ended, name), first=first, level=level,
                      noted=F.when(x["annotation"], F.coalesce(joined, x["line"])),
                      noted_to=F.when(x["annotation"], x["line"]),
                      out=_append(s["out"], ended, _block(name, first, x["line"])))

    start = dict(depth=F.lit(0), name=_none(), first=F.lit(0), level=F.lit(0), noted=_none("int"),
                   noted_to=_none("int"))
    return Machine(describe,
                   lambda x: (x["opened"] + x["closed"] > 0) | x["name"].isNotNull() | x["annotation"],
                   start, step, _open_to_last)


def _c() -> Machine:
    """Line ranges of C functions: from a brace opened at depth 0 to its end."""
    def step(s, x):
        before, after = s["depth"], s["depth"] + x["opened"] - x["closed"]
        header = s["name"].isNull() & (before == 0) & (x["opened"] > 0)
        name = F.when(header, "function").otherwise(s["name"])
        first = F.when(header, x["line"]).otherwise(s["first"])
        ended = name.isNotNull() & (after <= 0)
        return _state(depth=after.cast("int"), name=F.when(~ended, name), first=first,
                      out=_append(s["out"], ended, _block(name, first, x["line"])))

    start = dict(depth=F.lit(0), name=_none(), first=F.lit(0))
    return Machine(lambda c, raw: _brackets(c, "{", "}"), lambda x: x["opened"] + x["closed"] > 0,
                   start, step, _open_to_last)


def machines() -> dict[str, Machine]:
    """How blocks are found, by language; files of others have none."""
    return {"python": _python(), "javascript": _javascript(), "java": _java()}


def c_functions(pairs: Column) -> Column:
    return _fold(pairs, _c())


def lined(files: DataFrame, mask_c: bool = False) -> DataFrame:
    """Files with their lines as pairs of raw and masked text, numbered as a scan numbers them.

    C files are always cut into windows, so nothing of them is masked unless asked for.
    """
    raw = split_lines(F.col("content"))
    code = lexical.masked(F.col("content"), F.col("language"))
    code = split_lines(code if mask_c else F.when(F.col("language") == "c", F.col("content")).otherwise(code))
    return files.select("path", "language", "content",
                        F.arrays_zip(raw.alias("raw"), code.alias("code")).alias("pairs"))


def _blocks(language: Column, pairs: Column) -> Column:
    found = F.array().cast(_BLOCKS)
    for name, machine in reversed(machines().items()):
        found = F.when(language == name, _fold(pairs, machine)).otherwise(found)
    return F.transform(found, lambda b, i: F.struct(
        i.alias("chunk_id"), b["name"].alias("name"), (b["first"] - 1).alias("start_line"), b["last"].alias("end_line")))


def _windows(content: Column, size: int) -> Column:
    def cut(n):
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s, i: let(F.least(s + size, n), lambda e: F.struct(
            i.alias("chunk_id"), F.format_string("lines_%d_to_%d", s + 1, e).alias("name"),
            s.alias("start_line"), e.alias("end_line"))))
    return let(F.size(split_lines(content)), cut)


def _exploded(chunked: DataFrame, *carry) -> DataFrame:
    # The outer form keeps the optimizer from testing the array's size in a
    # filter below, which would work the whole fold out a second time.
    return (chunked.select("path", *carry, F.explode_outer("chunks").alias("c")).where("c is not null")
            .select("path", *carry, "c.chunk_id", "c.name", "c.start_line", "c.end_line"))


def code_blocks(files: DataFrame) -> DataFrame:
    """chunks(path, chunk_id, name, start_line, end_line): blocks of the languages that have them."""
    return _exploded(lined(files).select("path", _blocks(F.col("language"), F.col("pairs")).alias("chunks")))


def chunked(files: DataFrame, size: int = lookups.CHUNK_LINES) -> DataFrame:
    """Files with their chunks: blocks, or windows of ``size`` lines where there are none."""
    chunks = let(_blocks(F.col("language"), F.col("pairs")).cast(_CHUNKS), lambda b: F.when(F.size(b) > 0, b).otherwise(
        _windows(F.col("content"), size).cast(_CHUNKS)))
    return lined(files).select("path", "language", "pairs", chunks.alias("chunks"))


def chunk_bounds(files: DataFrame, size: int = lookups.CHUNK_LINES, *carry: str) -> DataFrame:
    """chunks(path, chunk_id, name, start_line, end_line) of every file.

    ``carry`` may name ``language`` to keep it on every chunk.
    """
    return _exploded(chunked(files, size).select("path", *carry, "chunks"), *carry)


def chunk_texts(files: DataFrame, size: int = lookups.CHUNK_LINES) -> DataFrame:
    """As ``chunk_bounds``, with the language and the text of every chunk.

    Texts are cut before the chunks become rows, so no row carries its whole file.
    """
    def with_text(c):
        lines = F.slice("pairs", c["start_line"] + 1, c["end_line"] - c["start_line"])
        return F.struct(c["chunk_id"].alias("chunk_id"), c["name"].alias("name"), c["start_line"].alias("start_line"),
                        c["end_line"].alias("end_line"),
                        F.array_join(F.transform(lines, lambda pair: pair["raw"]), "\n").alias("text"))
    return chunked(files, size).select("path", "language", F.inline(F.transform("chunks", with_text)))


def gaps(files: DataFrame) -> DataFrame:
    """Line ranges no block of a file with blocks covers; chunking leaves them out."""
    found = lined(files).select("path", F.size("pairs").alias("n"),
                                _blocks(F.col("language"), F.col("pairs")).alias("chunks"))

    def between(edges):
        return F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct(
            F.get(edges, i - 1)["b"].alias("start_line"), F.get(edges, i)["a"].alias("end_line")))

    bound = lambda line: F.array(F.struct(line.cast("int").alias("a"), line.cast("int").alias("b")))
    edges = F.concat(bound(F.lit(0)), F.transform(
        "chunks", lambda c: F.struct(c["start_line"].alias("a"), c["end_line"].alias("b"))), bound(F.col("n")))
    uncovered = F.filter(let(edges, between), lambda g: g["end_line"] > g["start_line"])
    return (found.select("path", F.inline_outer(F.when(F.size("chunks") > 0, uncovered)))
            .where("start_line is not null"))
