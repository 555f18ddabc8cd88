"""Rollups of resource samples: readings(run_id, at_us, cpu_percent, memory_mb,
rapl_energy_uj), with ``at_us`` the time in microseconds.

One run may hold a large share of all samples.  Whatever can be is a partial
aggregate; what needs neighbours works in short slices of a run and joins the
slices' borders, of which there is at most one per slice.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlines.functions import energy, lookups
from siftlines.operators.groups import with_totals

# Length of a slice.  A run of a year has about half a million of them.
SLICE_US = 60_000_000


def rollup_columns() -> list[Column]:
    """Aggregates of a run; they merge, so batch and stream share them."""
    measured = F.col("rapl_energy_uj").isNotNull()
    return [
        F.count("*").alias("n_samples"),
        F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"),
        F.coalesce(F.max("memory_mb"), F.lit(0.0)).alias("peak_memory_mb"),
        F.coalesce(F.avg("cpu_percent"), F.lit(0.0)).alias("avg_cpu_percent"),
        F.min_by("rapl_energy_uj", F.when(measured, F.struct("at_us", "sample_id"))).alias("first_uj"),
        F.max_by("rapl_energy_uj", F.when(measured, F.struct("at_us", "sample_id"))).alias("last_uj"),
    ]


def report_columns(df: DataFrame, cpu_seconds: Column | None = None, watts: float = lookups.TDP_WATTS) -> DataFrame:
    """Rollup to report: wall time, energy by counter or by model, carbon.

    Without a measured processor time it is load times wall time.
    """
    wall = (F.col("last_us") - F.col("first_us")) / 1_000_000.0
    timed = df.withColumn("wall_time_s", wall)
    timed = timed.withColumn("cpu_time_s", cpu_seconds if cpu_seconds is not None
                             else F.col("wall_time_s") * F.col("avg_cpu_percent") / 100.0)
    supported = F.col("first_uj").isNotNull() & F.col("last_uj").isNotNull()
    joules = F.when(supported, energy.counter_joules(F.col("first_uj"), F.col("last_uj"))).otherwise(
        energy.modelled_joules(F.col("cpu_time_s"), F.col("avg_cpu_percent"), watts))
    return timed.withColumns({"rapl_supported": supported, "estimated_energy_j": joules}).withColumn(
        "estimated_carbon_gco2", energy.grams_co2(F.col("estimated_energy_j")))


def run_reports(readings: DataFrame, **options) -> DataFrame:
    return report_columns(readings.groupBy("run_id").agg(*rollup_columns()), **options)


def counter_deltas(readings: DataFrame) -> DataFrame:
    """Joules per run from the first and the last counter value."""
    return readings.groupBy("run_id").agg(*rollup_columns()).select(
        "run_id", "first_uj", "last_uj",
        energy.counter_joules(F.col("first_uj"), F.col("last_uj")).alias("joules"))


def counter_totals(readings: DataFrame, *sample: str) -> DataFrame:
    """One counter value per sample: the sum over its domains."""
    return readings.groupBy(*sample).agg(F.sum("rapl_energy_uj").alias("rapl_energy_uj"))


def phase_durations(marks: DataFrame, slice_us: int = SLICE_US) -> DataFrame:
    """Seconds per (run, phase) of marks(run_id, phase, at_us, mark_id).

    A phase lasts from its mark to the run's next mark; the last one ends with
    the run.  Durations inside a slice come from a window over that slice; the
    step from a slice to the next one from a window over the slices' borders.
    """
    sliced = marks.withColumn("slice", F.floor(F.col("at_us") / slice_us))
    order = F.struct("at_us", "mark_id")
    within = Window.partitionBy("run_id", "slice").orderBy("at_us", "mark_id")
    inner = sliced.select("run_id", "phase", (F.lead("at_us").over(within) - F.col("at_us")).alias("us"))
    borders = sliced.groupBy("run_id", "slice").agg(
        F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"), F.max_by("phase", order).alias("phase"))
    following = F.lead("first_us").over(Window.partitionBy("run_id").orderBy("slice"))
    across = borders.select("run_id", "phase", (following - F.col("last_us")).alias("us"))
    return (inner.unionByName(across).groupBy("run_id", "phase")
            .agg((F.coalesce(F.sum("us"), F.lit(0)) / 1_000_000.0).alias("seconds")))


def phase_shares(durations: DataFrame) -> DataFrame:
    """Share of each phase in the run's time and against its longest phase."""
    # One row per phase name of a run: the marks are already summed up.
    run = Window.partitionBy("run_id")
    wall, longest = F.sum("seconds").over(run), F.max("seconds").over(run)
    share = lambda whole: F.when(whole > 0, F.col("seconds") / whole * 100).otherwise(0.0)
    return durations.withColumns({
        "wall_share": F.round(share(wall), 1), "longest_share": share(longest)})


def elapsed_series(readings: DataFrame) -> DataFrame:
    """Samples with the seconds since their run began, on two decimals.

    The start is joined back cell by cell, so a run with very many samples is
    spread over many tasks.
    """
    return with_totals(readings, "run_id", "sample_id", {"start_us": (F.min("at_us"), F.min)}).withColumn(
        "elapsed_s", F.round((F.col("at_us") - F.col("start_us")) / 1_000_000.0, 2)).drop("start_us")


def scalability_points(reports: DataFrame) -> DataFrame:
    """Reports as chart points, by load."""
    return reports.select("run_id", "n_samples", "wall_time_s", "avg_cpu_percent", "peak_memory_mb",
                          "estimated_energy_j", "estimated_carbon_gco2").orderBy("avg_cpu_percent", "run_id")
