"""Rollup of a stream of readings.

State is one row per run: counts, extremes, a mean and the first and last
counter value.  It grows with the number of runs, not of samples; runs never
end in this data model, so there is no watermark to drop them by.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siftlines import session
from siftlines.functions import energy
from siftlines.operators import metrics


def stream_rollup(readings: DataFrame) -> DataFrame:
    """Streaming or batch readings to one row per run."""
    return readings.groupBy("run_id").agg(*metrics.rollup_columns())


def run_available(spark: SparkSession, readings: DataFrame, folder: str | None = None) -> DataFrame:
    """Work off what the stream holds now and return the reports.

    ``folder``, on shared storage, keeps the state and the results; given again, the stream goes on where it was.
    Every batch writes the runs it has changed to its own folder, so a batch that is run again after
    a failure replaces what it had written; the last batch of a run holds its result.
    """
    folder = folder or f"{session.checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}"
    rolled = stream_rollup(readings)
    columns = rolled.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/results/batch={number}")

    query = (rolled.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    kept = T.StructType([*columns.fields, T.StructField("batch", T.LongType())])
    try:
        changes = spark.read.schema(kept).parquet(f"{folder}/results")
    except AnalysisException:  # no batch has been written yet
        changes = spark.createDataFrame([], kept)
    last = changes.groupBy("run_id").agg(F.max_by(F.struct(*columns.names), "batch").alias("last"))
    return metrics.report_columns(last.select("last.*"))


def events_stream(spark: SparkSession, folder: str, schema, name: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def readings_from_events(events: DataFrame, cores: int = 8) -> DataFrame:
    """readings of events(event_id, ts, user_id, event_type, value, props): a
    user is a run, the value its load, the property its memory in megabytes."""
    at_us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    size = F.get_json_object("props", "$.k").cast("double") * 1_000_000
    return events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("sample_id"), at_us.alias("at_us"),
        F.col("event_type").alias("domain"),
        energy.cpu_percent(F.col("value"), cores).alias("cpu_percent"),
        energy.megabytes(size).alias("memory_mb"),
        F.round(F.col("value") * 1_000_000).cast("long").alias("rapl_energy_uj"))
