import pytest
from pyspark.sql import functions as F

from siftlines.functions import energy
from siftlines.operators import metrics
from siftlines.plans import queries
from siftlines.streaming import rollup

SCHEMA = ("run_id long, sample_id long, at_us long, cpu_percent double, memory_mb double, rapl_energy_uj long, domain string")


@pytest.fixture
def readings(spark):
    return spark.createDataFrame([
        (1, 0, 1_000_000, 10.0, 5.0, 900, "a"), (1, 1, 3_500_000, 30.0, 9.0, 500, "b"), (1, 2, 2_000_000, 20.0, 7.0, None, "a"),
        (2, 3, 0, 50.0, 1.0, 1_000_000, "a"), (2, 4, 200_000_000, 50.0, 2.0, 4_000_000, "b"),
        (3, 5, 7, 40.0, 3.0, None, "a")], SCHEMA)


def test_reports(readings):
    got = {r.run_id: r for r in metrics.run_reports(readings).collect()}
    assert (got[1].wall_time_s, got[1].peak_memory_mb, got[1].avg_cpu_percent, got[1].n_samples) == (2.5, 9.0, 20.0, 3)
    assert got[1].estimated_energy_j == 0.0 and got[1].rapl_supported
    assert got[2].estimated_energy_j == 3.0
    assert got[2].estimated_carbon_gco2 == pytest.approx(3.0 / 3.6e6 * 475)
    assert not got[3].rapl_supported and got[3].estimated_energy_j == 0.0


def test_modelled_energy(one):
    assert one(energy.modelled_joules(F.lit(2.0), F.lit(50.0))) == 28.0
    assert one(energy.modelled_joules(F.lit(2.0), F.lit(0.1))) == pytest.approx(0.56)
    assert one(energy.modelled_joules(F.lit(0.0), F.lit(50.0))) == 0.0
    assert one(energy.cpu_percent(F.lit(1000.0), 8)) == 100.0
    assert one(energy.megabytes(F.lit(1048576))) == 1.0


def test_counter_totals(readings):
    got = {r.at_us: r.rapl_energy_uj for r in metrics.counter_totals(readings, "run_id", "at_us").collect()}
    assert got[1_000_000] == 900 and got[2_000_000] is None


@pytest.mark.parametrize("slice_us", [1, 5, 1000])
def test_phase_durations_do_not_depend_on_slices(spark, slice_us):
    marks = [(1, "a", 0, 0), (1, "b", 3, 1), (1, "a", 4, 2), (1, "c", 40, 3), (1, "c", 40, 4), (2, "a", 9, 5)]
    got = metrics.phase_durations(spark.createDataFrame(marks, "run_id long, phase string, at_us long, mark_id long"), slice_us)
    assert {(r.run_id, r.phase): round(r.seconds * 1e6) for r in got.collect()} == {
        (1, "a"): 39, (1, "b"): 1, (1, "c"): 0, (2, "a"): 0}


def test_phase_shares(spark):
    durations = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "a", 0.0)], "run_id long, phase string, seconds double")
    got = {(r.run_id, r.phase): (r.wall_share, round(r.longest_share, 3)) for r in metrics.phase_shares(durations).collect()}
    assert got == {(1, "a"): (75.0, 100.0), (1, "b"): (25.0, 33.333), (2, "a"): (0.0, 0.0)}


def test_elapsed_series(readings):
    got = {r.sample_id: r.elapsed_s for r in metrics.elapsed_series(readings).collect()}
    assert got == {0: 0.0, 1: 2.5, 2: 1.0, 3: 0.0, 4: 200.0, 5: 0.0}


def test_points_are_sorted_by_load(readings):
    assert [r.run_id for r in metrics.scalability_points(metrics.run_reports(readings)).collect()] == [1, 3, 2]


def test_stream_equals_batch(spark, data):
    batch = queries.metric_rollup(spark, data).orderBy("run_id").collect()
    assert queries.stream_rollup(spark, data).orderBy("run_id").collect() == batch


def test_stream_over_several_files(spark, readings, tmp_path):
    folder = str(tmp_path / "in")
    readings.repartition(3, "sample_id").write.parquet(folder)
    source = spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = rollup.run_available(spark, source).orderBy("run_id")
    assert got.collect() == metrics.run_reports(readings).orderBy("run_id").collect()
