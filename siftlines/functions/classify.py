"""Severity, category and risk expressions over findings."""

from pyspark.sql import Column, functions as F

from siftlines.functions import lookups
from siftlines.functions.text import truncate, unicode_regex


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def display_severity(severity: Column) -> Column:
    """HIGH, MEDIUM or LOW; an unknown value passes through in upper case."""
    upper = F.upper(F.coalesce(severity, F.lit("INFO")))
    return F.coalesce(F.try_element_at(_map(lookups.SEVERITY_DISPLAY), upper), upper)


def dashboard_severity(severity: Column) -> Column:
    """As ``display_severity``, but an unknown value counts as LOW."""
    shown = display_severity(severity)
    return F.when(shown.isin("HIGH", "MEDIUM", "LOW"), shown).otherwise("LOW")


def scored_severity(severity: Column) -> Column:
    """ERROR, WARNING or INFO; anything else counts as INFO."""
    upper = F.upper(severity)
    return F.when(upper.isin("ERROR", "WARNING"), upper).otherwise("INFO")


def _tag(message: Column, kind: str) -> Column:
    return F.regexp_extract(message, unicode_regex(rf"\[({kind})\]"), 1)


def weakness_id(message: Column) -> Column:
    """The bracketed weakness or vulnerability id of a message, else ``N/A``."""
    text = F.coalesce(message, F.lit(""))
    weakness, known = _tag(text, r"CWE-\d+"), _tag(text, r"CVE-[\d-]+")
    return F.when(weakness != "", weakness).when(known != "", known).otherwise("N/A")


def category(message: Column) -> Column:
    """Category of a message: by weakness id, by known-vulnerability id, by keyword."""
    text = F.coalesce(message, F.lit(""))
    weakness, known = _tag(text, r"CWE-\d+"), _tag(text, r"CVE-[\d-]+")
    lowered = F.lower(text)
    by_keyword = F.coalesce(
        *[F.when(F.contains(lowered, F.lit(word)), label) for word, label in lookups.KEYWORD_CATEGORY],
        F.lit("Other"))
    return (F.when(weakness != "",
                   F.coalesce(F.try_element_at(_map(lookups.WEAKNESS_CATEGORY), weakness), F.lit("Other")))
            .when(known != "", "Known CVE")
            .otherwise(by_keyword))


def short_message(message: Column) -> Column:
    """Message without its leading id tag, cut to 60 characters."""
    plain = F.regexp_replace(message, unicode_regex(r"^\[CWE-\d+\]\s*"), "")
    plain = F.regexp_replace(plain, unicode_regex(r"^\[CVE-[\d-]+\]\s*"), "")
    return truncate(plain, 60)


def risk_label(score: Column) -> Column:
    return (F.when(score >= 8, "CRITICAL").when(score >= 5, "HIGH")
            .when(score >= 2, "MEDIUM").otherwise("LOW"))


def panel_label(score: Column) -> Column:
    """The coarser banding of the top-files panel."""
    return F.when(score >= 8, "HIGH").when(score >= 5, "MEDIUM").otherwise("LOW")


def gauge_percent(score: Column) -> Column:
    return (score / 10.0 * 100).cast("int")


def finding_row(line: Column, severity: Column, message: Column, chunk: Column, indent: str) -> Column:
    """One line of a findings table."""
    weakness = weakness_id(message)
    tag = F.when(weakness != "N/A", F.concat(F.lit(" ("), weakness, F.lit(")"))).otherwise("")
    tail = F.when(F.coalesce(chunk, F.lit("")) != "",
                  F.concat(F.lit("  (chunk: "), chunk, F.lit(")"))).otherwise("")
    number = F.coalesce(line, F.lit(0)).cast("string")
    return F.concat(
        F.lit(f"{indent}Line "), F.lpad(number, F.greatest(F.char_length(number), F.lit(4)), F.lit(" ")),
        F.lit("  ["), _pad(display_severity(severity), 6), F.lit("]  "),
        category(message), _pad(tag, 24), F.lit(" — "), short_message(message), tail)


def with_snippet(row: Column, source_line: Column, indent: str) -> Column:
    """A row of a findings table with the source line below it, if there is one."""
    return F.when(source_line != "", F.concat(row, F.lit(f"\n{indent}{'':>14s}|-- "), source_line)).otherwise(row)


def chunk_row(line: Column, severity: Column, message: Column) -> Column:
    """One line of a chunk's findings: the message is cut hard at 70 characters."""
    weakness = weakness_id(message)
    tag = F.when(weakness != "N/A", F.concat(F.lit(" ("), weakness, F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), display_severity(severity), F.lit("] Line "), line.cast("string"), F.lit(" -- "),
                    category(message), tag, F.lit(": "), F.substring(message, 1, 70))


def _pad(text: Column, width: int) -> Column:
    return F.rpad(text, F.greatest(F.char_length(text), F.lit(width)), F.lit(" "))
