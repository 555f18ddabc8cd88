"""Text that goes into and comes out of a summariser."""

from pyspark.sql import Column, functions as F

from siftlines.functions import lookups
from siftlines.functions.text import let, strip


def clean_summary(raw: Column) -> Column:
    """Rewrite three stock openings, capitalise, end with a period."""
    return let(strip(raw), lambda s: _finish(_reword(s)))


def _reword(s: Column) -> Column:
    low = F.lower(s)
    rest = lambda start: F.substring(s, start + 1, 2**31 - 1)
    return (F.when(low.startswith("summarize "), F.concat(F.lit("Handles "), strip(rest(10))))
            .when(low.startswith("summary for a single"),
                  F.concat(F.lit("Implements logic for a single"), rest(20)))
            .when(low.startswith("summary for "), F.concat(F.lit("Provides logic for "), strip(rest(12))))
            .otherwise(s))


def _finish(summary: Column) -> Column:
    return let(summary, lambda s: F.when(s == "", s).otherwise(F.concat(
        F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2**31 - 1),
        F.when(F.endswith(s, F.lit(".")), "").otherwise("."))))


def named_code(path: Column, content: Column) -> Column:
    """Code with its file name on top."""
    return F.concat(F.lit("// File: "), F.element_at(F.split(path, "/"), -1), F.lit("\n"), content)


def finding_note(severity: Column, message: Column, line: Column) -> Column:
    return F.concat(severity, F.lit(" - "), message, F.lit(" (line "), line.cast("string"), F.lit(")"))


def prompt(notes: Column, sources: Column, sinks: Column, complexity: Column, code: Column) -> Column:
    """Prompt for a summariser.

    ``notes`` are the finding notes; without any, the prompt is only the start
    of the code.  Names are listed once, sorted.
    """
    start = F.substring(code, 1, lookups.PROMPT_CODE_CHARS)
    names = lambda found: F.when(F.size(found) > 0, F.array_join(
        F.array_sort(F.array_distinct(found)), ", ")).otherwise("none")
    header = F.concat(
        F.lit("/* sinks="), names(sinks), F.lit(" | sources="), names(sources),
        F.lit(" | complexity="), complexity.cast("string"),
        F.lit(" | security_findings="), F.array_join(notes, "; "), F.lit(" */"))
    return F.when(F.size(notes) > 0, F.concat(header, F.lit("\n"), start)).otherwise(start)
