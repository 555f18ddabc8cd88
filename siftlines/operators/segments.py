"""Code blocks of files too large for one row.

A large file is segments(path, language, seg, content): pieces in the order of ``seg``, all but the last ending with a newline.
What a piece means depends on what comes before it, so the fold of a piece is a function of a state: the string or comment it
begins in, then the bracket depth and the open block.  All pieces are worked out at once from a guess of that state (code, no open block; the
depth is a sum and is known), and the states at their ends are chained along the file.  Pieces whose guess was
wrong are worked out again from the state that the chain gives; most end as they did before, so two or three rounds settle a file
of any length.  A piece that an open string or block runs through as a whole needs no second look.

Contents are read where they lie; between pieces move states, counts and line numbers, one row a piece.  What is joined to the
pieces is that small table, and the planner broadcasts it if it is small enough.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlines import session
from siftlines.functions import lexical, lookups
from siftlines.functions.text import let, split_lines
from siftlines.operators import blocks

# What strings and comments of several lines open and close with, and how a piece that begins inside one closes it.
_SPANS = {
    "python": [('"""', '"""', '"""'), ("'''", "'''", "'''")],
    "javascript": [("/*", "*/", r"\*/"), ("`", "`", r"^[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`")],
    "java": [("/*", "*/", r"\*/")],
}

_ITEM = ("struct<line:int,above:int,top:boolean,decorator:boolean,name:string,opened:int,closed:int,curly:boolean,body:boolean,"
         "annotation:boolean,bodyless:boolean>")
_STATE = "struct<depth:int,name:string,first:int,decorated:boolean,body:boolean,level:int,noted:int,noted_to:int>"
_FIELDS = {"depth": "int", "name": "string", "first": "int", "decorated": "boolean", "body": "boolean", "level": "int", "noted": "int",
           "noted_to": "int"}
_FOUND = "array<struct<name:string,first:int,last:int>>"


def cut(files: DataFrame, lines: int) -> DataFrame:
    """segments(path, language, seg, content) of ``lines`` newline-ended lines each, from files(path, content, language)."""
    parts = F.split("content", "\n", -1)

    def pieces(parts):
        n = F.size(parts)
        return F.transform(F.sequence(F.lit(0), n - 1, F.lit(lines)), lambda s, i: F.struct(
            i.cast("long").alias("seg"),
            F.concat(F.array_join(F.slice(parts, s + 1, F.lit(lines)), "\n"), F.when(s + lines < n, "\n").otherwise("")).alias("content")))

    return files.select("path", "language", F.inline(let(parts, pieces))).where("seg = 0 or content <> ''")


def _pick(language: Column, build, otherwise: Column) -> Column:
    chosen = otherwise
    for name in _SPANS:
        chosen = F.when(language == name, build(name)).otherwise(chosen)
    return chosen


def _opener(language: Column, mode: Column, which: int) -> Column:
    """The sign that opens (0) or closes (1) a string or comment, '' in code."""
    return _pick(language, lambda name: F.element_at(F.array(F.lit(""), *[F.lit(span[which]) for span in _SPANS[name]]), mode + 1), F.lit(""))


def _before(language: Column, mode: Column) -> Column:
    """What a piece has to follow to be read as it is in its file: an opening sign, or a newline in code."""
    return F.when(mode > 0, _opener(language, mode, 0)).when(F.col("place") > 1, "\n").otherwise("")


def _exit_mode(language: Column, content: Column, entry: Column, later: Column) -> Column:
    """The string or comment a piece ends in (0: none), if it begins in ``entry``.

    With the closing sign put behind it, an open string or comment becomes the last piece of the text; of several candidates the one that
    opened first counts.  One that no later piece closes is none.
    """
    def among(name):
        def reach(i, span):
            pieces = F.regexp_extract_all(F.concat(_before(language, entry), content, F.lit(span[1])), F.lit(lexical.PIECES[name]), 0)
            whole = lambda p: F.when(p.startswith(span[0]) & p.endswith(span[1]) & (
                F.char_length(p) >= len(span[0]) + len(span[1])), F.char_length(p)).otherwise(0)
            length = let(F.element_at(pieces, -1), whole)
            return F.struct(F.when(F.get(later, F.lit(i)), length).otherwise(0).alias("length"), F.lit(i + 1).alias("mode"))
        best = F.array_max(F.array(*[reach(i, span) for i, span in enumerate(_SPANS[name])]))
        return let(best, lambda b: F.when(b["length"] > 0, b["mode"]).otherwise(0))
    return _pick(language, among, F.lit(0))


def _chained(known: DataFrame, keep, again, entry_type: str, passes) -> DataFrame:
    """``known``(path, seg, used, exit, ...) with every piece worked out from the state the piece before it ends in.

    ``again(wanted)`` works pieces out for wanted(path, seg, entry).  ``passes(row, entry)`` gives the state a piece ends in when
    that is plain without working it out, else None.  Adds ``passed``.
    """
    schema = f"path string, seg long, entry {entry_type}, passed boolean, stale boolean"
    tasks = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chain(batches):
        path, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                first = not begun or row["path"] != path
                entry = row["used"] if first else state
                moved = entry != row["used"]
                through = passes(row, entry) if moved else None
                out.append((row["path"], row["seg"], entry, through is not None, moved and through is None))
                path, state, begun = row["path"], row["exit"] if through is None else through, True
            kind = batch.schema.field("used").type
            kinds = [pa.string(), pa.int64(), kind, pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(column, of) for column, of in zip(zip(*out), kinds)],
                                             ["path", "seg", "entry", "passed", "stale"]) if out else pa.RecordBatch.from_pylist(
                [], pa.schema(list(zip(["path", "seg", "entry", "passed", "stale"], kinds))))

    while True:
        small = known.drop("found")
        # A task takes many files, one after the other: a group a file would cost a call a file.  Rows are small, so their number of
        # bytes would put all of them into one task; the number of tasks is given instead.
        linked = keep(small.repartition(tasks, "path").sortWithinPartitions("path", "seg").mapInArrow(chain, schema))
        wanted = linked.where("stale").select("path", "seg", "entry")
        if wanted.isEmpty():
            return known.join(linked.select("path", "seg", "passed", "entry"), ["path", "seg"])
        known = keep(known.join(wanted.select("path", "seg"), ["path", "seg"], "left_anti").unionByName(again(wanted)))


def _modes(segments: DataFrame, keep) -> DataFrame:
    """(path, seg, place, entry_mode, exit_mode) of every piece."""
    closes = _pick(F.col("language"), lambda name: F.array(*[F.rlike("content", F.lit(span[2])) for span in _SPANS[name]]),
                   F.array().cast("array<boolean>"))
    flags = keep(segments.select("path", "language", "seg", closes.alias("closes")))
    order = Window.partitionBy("path").orderBy("seg")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    later = F.array(*[F.coalesce(F.max(F.get("closes", F.lit(i))).over(after), F.lit(False)) for i in range(2)])
    flags = keep(flags.select("path", "seg", "closes", later.alias("later"), F.row_number().over(order).alias("place")))

    def again(wanted):
        exits = _exit_mode(F.col("language"), F.col("content"), F.col("entry"), F.col("later"))
        return segments.join(flags, ["path", "seg"]).join(wanted, ["path", "seg"]).select(
            "path", "seg", "place", "closes", F.col("entry").alias("used"), exits.alias("exit"))

    first = keep(again(flags.select("path", "seg", F.lit(0).alias("entry"))))
    known = _chained(first, keep, again, "int", lambda row, entry: entry if entry and not row["closes"][entry - 1] else None)
    return keep(known.select("path", "seg", "place", F.col("entry").alias("entry_mode"),
                             F.when(F.col("passed"), F.col("entry")).otherwise(F.col("exit")).alias("exit_mode")))


def _items(segments: DataFrame, modes: DataFrame) -> DataFrame:
    """(path, language, seg, n_lines, items, last): a piece's lines that matter for blocks, numbered within it."""
    language = F.col("language")
    whole = F.concat(_before(language, F.col("entry_mode")), F.col("content"), _opener(language, F.col("exit_mode"), 1))
    led = (F.col("entry_mode") == 0) & (F.col("place") > 1)  # a newline was put before it
    code = let(split_lines(lexical.masked(whole, language)), lambda c: F.when(led, F.slice(c, F.lit(2), F.size(c))).otherwise(c))
    raw = split_lines(F.col("content"))
    paired = segments.join(modes, ["path", "seg"]).select(
        "path", "language", "seg", F.size(raw).alias("n_lines"),
        F.when(language.isin(*_SPANS), F.arrays_zip(raw.alias("raw"), code.alias("code"))).alias("pairs"))

    def widened(found):
        def wide(x, names):
            fields = dict(f.split(":") for f in _ITEM[len("struct<"):-1].split(","))
            return F.struct(*[(x[f] if f in names else F.lit(None)).cast(kind).alias(f) for f, kind in fields.items()])
        names = {"python": ("line", "above", "top", "decorator", "name"),
                 "javascript": ("line", "above", "opened", "closed", "curly", "name", "body"),
                 "java": ("line", "above", "opened", "closed", "curly", "name", "annotation", "bodyless")}
        return lambda name: let(found(name), lambda f: F.struct(
            F.transform(f["items"], lambda x: wide(x, names[name])).alias("items"), f["last"].alias("last")))

    machines = blocks.machines()
    build = widened(lambda name: blocks.relevant_items(F.col("pairs"), machines[name]))
    none = F.struct(F.array().cast(f"array<{_ITEM}>").alias("items"), F.lit(0).alias("last"))
    return paired.select("path", "language", "seg", "n_lines", _pick(language, build, none).alias("f")).select(
        "path", "language", "seg", "n_lines", "f.items", "f.last")


def _located(items: DataFrame, keep) -> DataFrame:
    """(path, seg, offset, above, depth, total): lines before a piece, the last filled one of them, the depth it begins at, and the
    lines of its file."""
    net = F.aggregate("items", F.lit(0), lambda s, x: s + F.coalesce(x["opened"] - x["closed"], F.lit(0)))
    small = keep(items.select("path", "seg", "n_lines", "last", net.alias("net")))
    order = Window.partitionBy("path").orderBy("seg")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summed = small.withColumn("offset", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).cast("int")).withColumn(
        "depth", F.coalesce(F.sum("net").over(before), F.lit(0)).cast("int"))
    return keep(summed.select(
        "path", "seg", "offset", "depth", F.sum("n_lines").over(Window.partitionBy("path")).cast("int").alias("total"),
        F.coalesce(F.max(F.when(F.col("last") > 0, F.col("offset") + F.col("last"))).over(before), F.lit(0)).alias("above")))


def _folded(placed: DataFrame, machines: dict) -> DataFrame:
    """Pieces (path, language, seg, items, entry) after their fold: (path, seg, used, exit, found, low, n_items, first_above)."""
    def fold(name):
        machine = machines[name]
        start = {field: F.col(f"entry.{field}") for field in machine.start}

        def finish(found, state):
            end = F.struct(*[(state[f] if f in machine.start else F.lit(None)).cast(kind).alias(f) for f, kind in _FIELDS.items()])
            # Where no block is open, what is left of the last one says nothing.
            clean = F.struct(*[(F.when(end["name"].isNotNull() | (F.lit(name == "python") & F.coalesce(end["decorated"], F.lit(False))), end[f])
                                if f in ("first", "body", "level") else end[f]).alias(f) for f in _FIELDS])
            return F.struct(clean.cast(_STATE).alias("exit"), F.concat(found, state["out"]).cast(_FOUND).alias("found"))
        return blocks.fold_items(F.col("items"), machine, start, finish)

    none = F.struct(F.col("entry").cast(_STATE).alias("exit"), F.array().cast(_FOUND).alias("found"))
    depths = F.aggregate("items", F.struct(F.col("entry.depth").alias("at"), F.col("entry.depth").alias("low")), lambda s, x: let(
        s["at"] + F.coalesce(x["opened"] - x["closed"], F.lit(0)), lambda d: F.struct(d.alias("at"), F.least(s["low"], d).alias("low"))))
    return placed.select("path", "language", "seg", F.col("entry").alias("used"), _pick(F.col("language"), fold, none).alias("f"),
                         depths["low"].alias("low"), F.size("items").alias("n_items"), F.get("items", F.lit(0))["above"].alias("first_above")
                         ).select("path", "language", "seg", "used", "f.exit", "f.found", "low", "n_items", "first_above")


def _runs_through(row: dict, entry: dict) -> dict | None:
    """The state at the end of a piece that an open block runs through as a whole, None if it may not."""
    if not row["n_items"]:
        return entry
    joins = entry["noted"] is not None and entry["noted_to"] == row["first_above"]
    level = {"javascript": 0, "java": entry["level"]}.get(row["language"])  # where the open block ends
    if entry["name"] is None or joins or level is None or row["low"] <= level:
        return None
    return entry | {f: row["exit"][f] for f in ("depth", "noted", "noted_to")}


def segment_blocks(segments: DataFrame, keep=None) -> DataFrame:
    """chunks(path, chunk_id, name, start_line, end_line): the blocks of ``blocks.code_blocks``, from segments of files."""
    return _chunks(segments, keep, 0)


def segment_chunks(segments: DataFrame, size: int = lookups.CHUNK_LINES, keep=None) -> DataFrame:
    """As ``segment_blocks``, with windows of ``size`` lines for files without blocks."""
    return _chunks(segments, keep, size)


def _chunks(segments: DataFrame, keep, size: int) -> DataFrame:
    keep = keep or session.Run(segments.sparkSession).keep
    modes = _modes(segments, keep)
    items = keep(_items(segments, modes))
    located = _located(items, keep)
    # Line numbers of the file from here on.
    moved = F.transform("items", lambda x: x.withField("line", x["line"] + F.col("offset")).withField(
        "above", F.when(x["above"] > 0, x["above"] + F.col("offset")).otherwise(F.col("above"))))
    placed = keep(items.join(located, ["path", "seg"]).select(
        "path", "language", "seg", moved.alias("items"), "depth",
        F.when(F.col("last") > 0, F.col("offset") + F.col("last")).otherwise(F.col("above")).alias("last")))
    machines = blocks.machines()
    fresh = F.struct(*[F.lit({"depth": None, "decorated": False}.get(f)).cast(kind).alias(f) if f != "depth" else F.when(
        F.col("language") == "python", None).otherwise(F.col("depth")).cast("int").alias("depth") for f, kind in _FIELDS.items()])
    fresh = F.when(F.col("language") == "python", fresh).otherwise(fresh.withField("decorated", F.lit(None).cast("boolean")))

    def again(wanted):
        return _folded(placed.join(wanted, ["path", "seg"]), machines)

    first = keep(_folded(placed.withColumn("entry", fresh.cast(_STATE)), machines))
    known = keep(_chained(first, keep, again, _STATE, _runs_through))
    inside = F.col("passed") & F.col("entry.name").isNotNull()
    parts = known.select("path", "seg", F.when(inside, F.array().cast(_FOUND)).otherwise(F.col("found")).alias("found"), "exit", "entry", inside.alias("inside"))
    # The block still open where a file ends.
    ends = placed.groupBy("path").agg(F.max_by("seg", "seg").alias("seg"), F.max_by("last", "seg").alias("last"))
    state = F.when(F.col("inside"), F.col("entry")).otherwise(F.col("exit"))
    closed = parts.join(ends, ["path", "seg"], "left").select("path", "seg", F.when(
        F.col("last").isNotNull() & state["name"].isNotNull(), F.concat("found", F.array(F.struct(
            state["name"].alias("name"), state["first"].alias("first"), F.col("last").cast("int").alias("last"))).cast(_FOUND))
    ).otherwise(F.col("found")).alias("found"))
    closed = keep(closed)
    before = Window.partitionBy("path").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    counts = keep(closed.select("path", "seg", F.size("found").alias("n"))).withColumn(
        "start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = closed.join(counts.select("path", "seg", "start"), ["path", "seg"]).select(
        "path", "start", F.posexplode("found").alias("at", "b")).select(
        "path", (F.col("start") + F.col("at")).cast("int").alias("chunk_id"), "b.name", (F.col("b.first") - 1).alias("start_line"),
        F.col("b.last").alias("end_line"))
    if not size:
        return found
    without = counts.groupBy("path").agg(F.sum("n").alias("n")).where("n = 0").join(
        located.groupBy("path").agg(F.max("total").alias("total")), "path").where("total > 0")
    windows = without.select("path", "total", F.posexplode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(size))).alias("chunk_id", "start_line"))
    end = F.least(F.col("start_line") + size, F.col("total"))
    return found.unionByName(windows.select(
        "path", "chunk_id", F.format_string("lines_%d_to_%d", F.col("start_line") + 1, end).alias("name"), "start_line", end.alias("end_line")))
