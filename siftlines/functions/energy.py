"""Expressions over resource samples."""

from pyspark.sql import Column, functions as F

from siftlines.functions import lookups


def cpu_percent(raw: Column, cores: int) -> Column:
    """Per-core load as a share of the machine, at most 100."""
    return F.least(raw / cores, F.lit(100.0))


def megabytes(size: Column) -> Column:
    return size / (1024 * 1024)


def modelled_joules(cpu_seconds: Column, avg_cpu: Column, watts: float = lookups.TDP_WATTS) -> Column:
    """Energy from rated power, load (at least 1 %) and processor time."""
    return F.when(cpu_seconds == 0, 0.0).otherwise(
        F.lit(watts) * F.greatest(avg_cpu / 100.0, F.lit(0.01)) * cpu_seconds)


def counter_joules(first: Column, last: Column) -> Column:
    """Energy from a microjoule counter; a counter that went back counts as 0."""
    return F.greatest(last - first, F.lit(0)) / 1_000_000.0


def grams_co2(joules: Column) -> Column:
    return joules / lookups.JOULES_PER_KWH * lookups.GRAMS_CO2_PER_KWH
