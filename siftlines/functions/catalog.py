"""The rule catalogue as rows, in the order findings are emitted."""

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlines import schema
from siftlines.functions import rule_values as values

EVERY_LANGUAGE = ("python", "javascript", "java", "c")
SHARED = "shared"


@dataclass(frozen=True)
class Rule:
    """A line rule: a line hits when ``pattern`` matches and no ``exclude`` does."""

    rule_id: str
    language: str
    severity: str
    message: str
    pattern: str
    anchor: str = ""
    exclude: tuple[str, ...] = ()


def line_rules() -> list[Rule]:
    """The 123 line rules: the shared one, then each language's, in order."""
    tables = [(SHARED, values.LINE_RULES_SHARED), ("python", values.LINE_RULES_PYTHON),
              ("javascript", values.LINE_RULES_JAVASCRIPT), ("java", values.LINE_RULES_JAVA),
              ("c", values.LINE_RULES_C)]
    return [Rule(rule_id, language, severity, message, pattern, anchor)
            for language, rows in tables
            for rule_id, severity, anchor, pattern, message in rows]


def rule_file_rows():
    for language, rows in [("python", values.RULE_FILE_PYTHON), ("c", values.RULE_FILE_C),
                           ("java", values.RULE_FILE_JAVA), ("javascript", values.RULE_FILE_JAVASCRIPT)]:
        for row in rows:
            yield language, row


# Anchors of the patterns that only the rule file has.
_OWN_ANCHORS = {
    "python-nosqli-pymongo": ".find",
    "python-path-traversal-open": "open",
    "python-django-extra-sql": ".extra",
    "js-express-disable-xpoweredby": "app.use",
    "js-cookie-no-httponly": "res.cookie",
    "js-cookie-no-secure": "res.cookie",
}


def rule_file_rules() -> list[Rule]:
    """The rule file's single-line rules, ``pattern-not`` clauses included.

    A rule with two alternative patterns gives two rows with the same id.
    """
    by_id = {r.rule_id: r for r in line_rules()}
    rules = []
    for language, (rule_id, severity, _, _, _, message, patterns, exclude) in rule_file_rows():
        for pattern in patterns:
            known = by_id.get(pattern)
            rules.append(Rule(rule_id, language, severity, message,
                              known.pattern if known else pattern,
                              known.anchor if known else _OWN_ANCHORS[rule_id], exclude))
    return rules


def sequence_rules() -> dict[str, tuple[str, str]]:
    """id -> (severity, message) of the rules that span several statements."""
    return {row[0]: (row[1], row[5]) for _, row in rule_file_rows() if not row[6]}


def for_language(rules: list[Rule], language: str) -> list[Rule]:
    """Rules that apply to one language: the shared ones first."""
    return [r for r in rules if r.language in (SHARED, language)]


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Line rules as a DataFrame, one row per rule and language it runs on."""
    rows = [(r.rule_id, language, order, r.severity, r.message, r.pattern)
            for language in EVERY_LANGUAGE
            for order, r in enumerate(for_language(rules, language))]
    # An Arrow table becomes a local relation, so the planner knows its size.
    names = ["rule_id", "language", "ord", "severity", "message", "pattern"]
    columns = [list(c) for c in zip(*rows)]
    return spark.createDataFrame(pa.table(dict(zip(names, columns)))).withColumn("ord", F.col("ord").cast("int"))


def rule_file_table(spark: SparkSession) -> DataFrame:
    """All 130 rules of the rule file with their metadata."""
    rows = []
    for language, (rule_id, severity, cwe, kind, owasp, message, patterns, exclude) in rule_file_rows():
        clauses = [("pattern", p) for p in patterns] + [("pattern-not", p) for p in exclude]
        rows.append((rule_id, [language], severity, message, clauses, (kind, cwe, owasp)))
    return spark.createDataFrame(rows, schema.RULE_FILE)


def rule_counts(rules: DataFrame) -> DataFrame:
    """Rules per language, severity and category of a rule-file table."""
    return (rules.select(F.explode("languages").alias("language"), "severity",
                         F.col("metadata.category").alias("category"))
            .groupBy("language", "severity", "category").agg(F.count("*").alias("n_rules")))
