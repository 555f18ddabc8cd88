"""Schemas of the tables that move between operators."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("language", T.StringType()),
])

FINDINGS = T.StructType([
    T.StructField("check_id", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("message", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("snippet", T.StringType()),
])

RULE_FILE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("patterns", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
    ]))),
    T.StructField("metadata", T.StructType([
        T.StructField("category", T.StringType()),
        T.StructField("cwe", T.StringType()),
        T.StructField("owasp", T.StringType()),
    ])),
])

# One element of the JSON a pattern scanner prints.
SCANNER_RESULT = T.StructType([
    T.StructField("check_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("start", T.StructType([T.StructField("line", T.IntegerType())])),
    T.StructField("extra", T.StructType([
        T.StructField("message", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("lines", T.StringType()),
    ])),
])
SCANNER_OUTPUT = T.StructType([
    T.StructField("results", T.ArrayType(SCANNER_RESULT)),
])

FEATURES = T.StructType([
    T.StructField("sources", T.ArrayType(T.StringType())),
    T.StructField("sinks", T.ArrayType(T.StringType())),
    T.StructField("complexity", T.IntegerType()),
])

FILE_RESULT = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("line_count", T.IntegerType()),
    T.StructField("big_file", T.BooleanType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("findings", T.ArrayType(FINDINGS)),
    T.StructField("features", FEATURES),
    T.StructField("summary", T.StringType()),
    T.StructField("error", T.StringType()),
])

READING = T.StructType([
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("cpu_percent", T.DoubleType()),
    T.StructField("memory_mb", T.DoubleType()),
    T.StructField("rapl_energy_uj", T.LongType()),
])

REPORT = T.StructType([
    T.StructField("wall_time_s", T.DoubleType()),
    T.StructField("cpu_time_s", T.DoubleType()),
    T.StructField("peak_memory_mb", T.DoubleType()),
    T.StructField("avg_cpu_percent", T.DoubleType()),
    T.StructField("estimated_energy_j", T.DoubleType()),
    T.StructField("estimated_carbon_gco2", T.DoubleType()),
    T.StructField("rapl_supported", T.BooleanType()),
    T.StructField("phase_timings", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("readings", T.ArrayType(READING)),
])
