"""Plans whose memory, on the driver and in a task, must not grow with the table."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxframe import session
from fluxframe.operators import chemistry, fitting, grids, posterior, profiles, ranks, score
from fluxframe.plans import views

MASSES = "col_id bigint, layer bigint, species string, volume_mixing_ratio double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_options_are_broadcast_and_spectra_are_not(spark, tmp_path):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [{"sample_id": s, "model": "m", "column_id": 0, "column_weight": 1.0, "wavelength": [1.0, 1.1, 1.2, 1.3, 1.4], "flux": [float(s)] * 5, "extra_log_l": None}
                for s in batch.column("sample_id").to_pylist()]
        kinds = [("sample_id", pa.int64()), ("model", pa.string()), ("column_id", pa.int32()), ("column_weight", pa.float64()), ("wavelength", pa.list_(pa.float64())),
                 ("flux", pa.list_(pa.float64())), ("extra_log_l", pa.float64())]
        return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    spark.range(20).withColumnRenamed("id", "sample_id").write.parquet(f"{tmp_path}/p")  # a file: its estimate is small, and so that of the spectra
    models = fitting.model_spectra(spark.read.parquet(f"{tmp_path}/p"), kernel)
    data = spark.createDataFrame([("a", 1.1, 0.1, 3.0, 1.0), ("a", 1.2, 0.1, 3.0, 1.0)], "dataset string, wavelength double, bin_width double, flux double, uncertainty double")
    datasets = spark.createDataFrame([("a", "m")], "dataset string, source string")
    got = fitting.observed_models(models, data, datasets)
    joins = re.findall(r"BroadcastHashJoin \[source#[^\n]*", plan(got))
    assert joins and all("BuildRight" in j for j in joins)
    assert {(r.sample_id, round(r.wavelength, 6), round(r.model, 9)) for r in got.collect()} == {(s, w, float(s)) for s in range(20) for w in (1.1, 1.2)}
    names = spark.range(20).select(F.col("id").alias("sample_id"), F.lit("none").alias("name"), F.lit(0.0).alias("value"))
    scored = plan(fitting.score_models(models, data, datasets, names))
    joins = re.findall(r"BroadcastHashJoin \[dataset#\w+\], \[dataset#[^\n]*", scored)
    assert joins and not any("BuildLeft" in j for j in joins if "Inner" in j)


def test_tables_of_samples_are_never_broadcast(spark, tmp_path):
    spark.range(20).select(F.col("id").alias("sample_id"), (F.col("id") / 10).alias("v")).write.parquet(f"{tmp_path}/p")
    samples = spark.read.parquet(f"{tmp_path}/p")  # a small file: left alone, Spark broadcasts whatever is made of it
    rows = samples.select("sample_id", F.lit("a").alias("dataset"), F.lit(1.0).alias("uncertainty"), F.col("v").alias("log_l"))
    names = samples.select("sample_id", F.explode(F.array(F.lit("a_b"), F.lit("uncertainty_scaling_b"))).alias("name"), F.col("v").alias("value"))
    grown = score.inflate_sigma(rows, names, by=["sample_id"])
    total = score.total_loglik(rows, ["sample_id"], samples.select("sample_id", F.col("v").alias("log_prior")))
    line = samples.select("sample_id", F.explode(F.array(*[F.lit(1.0 + 0.1 * i) for i in range(8)])).alias("wavelength"), F.col("v").alias("flux"))
    bins = spark.createDataFrame([(1.2, 0.1), (1.3, 0.1)], "wavelength double, bin_width double")
    binned = [grids.rebin(line, bins, ["sample_id"], target_by=[], widths="bin_width", strict=strict) for strict in (True, False)]
    for df in (grown, total, *binned):
        assert "SortMergeJoin" in plan(df) and not re.search(r"BroadcastHashJoin \[sample_id", plan(df))
    assert {(r.sample_id, round(r.uncertainty, 9)) for r in grown.collect()} == {(s, round((1 + 10 ** (s / 10)) ** 0.5, 9)) for s in range(20)}
    assert {(r.sample_id, round(r.log_l, 9)) for r in total.collect()} == {(s, round(s / 5, 9)) for s in range(20)}
    for df in binned:
        assert sorted((r.sample_id, round(r.flux, 9)) for r in df.collect()) == sorted((s, s / 10) for s in range(20) for _ in range(2))


def test_three_region_on_a_shared_grid_meets_nothing(spark):
    rows = [(s, p) for s, p in enumerate([2.0, -2.0, -5.0, -2.5, -9.0, 7.0, None])]
    df = profiles.over_pressures(spark.createDataFrame(rows, "sample_id bigint, p double"), -6.0, 3.0, 10)
    points, rest = [-6.0, -4.0, -1.5, 1.0, F.col("p")], (F.lit(1000.0), (0.7, 0.3))
    apart = profiles.three_region(df, points, *rest, levels=[-6.0 + i for i in range(10)])
    joined = profiles.three_region(df, points, *rest)
    assert sorted(map(str, apart.collect())) == sorted(map(str, joined.collect()))
    assert "Join" not in plan(apart) and "Exchange" not in plan(apart)


def test_partitions_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    df = spark.range(1000)
    assert session.in_parts(df, ["id"], 1000).rdd.getNumPartitions() == 100
    assert session.in_parts(df, ["id"], 3).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.fixture
def lines(spark, tmp_path):
    rows = [(1, 1, 7, 3.0), (1, 1, 14, 5.0), (1, 1, 8, 2.0), (1, 2, 9, 4.0), (2, 1, 9, None), (None, 1, 7, 1.0), (3, None, 7, 1.0), (1, 1, 7, 3.0)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_abundances_are_dealt_once(spark, lines):
    df = views.abundances(spark, lines)
    got = {(r.col_id, r.layer, r.species_id): r.mass_fraction for r in df.collect()}
    assert got == {(1, 1, 0): 11 / 13, (1, 1, 1): 2 / 13, (1, 2, 2): 1.0, (2, 1, 2): None}
    later = df.groupBy("col_id", "layer").agg(F.sum("mass_fraction"))
    assert re.findall(r"REPARTITION_BY_\w+|ENSURE_REQUIREMENTS", plan(later)) == ["REPARTITION_BY_NUM"]


def test_layers_are_not_dealt_by_species(spark, tmp_path):
    spark.createDataFrame([(1, 1, "H2O", 0.5), (1, 1, "e-", 0.5)], MASSES).write.parquet(f"{tmp_path}/v")
    elements = spark.createDataFrame([("H2O", "H", 2), ("H2O", "O", 1)], "species string, element string, n bigint")
    got = chemistry.element_abundances(spark.read.parquet(f"{tmp_path}/v"), elements)
    assert {(r.element, r.amount) for r in got.collect()} == {("H", 1.5), ("O", 0.5)}
    assert "hashpartitioning(species" not in plan(got)


def test_fixed_parameters_by_bounded_parts(spark):
    rows = [(s, p, 1.0) for s in (1, 1, 2, None) for p in ("a", "b")]
    samples = spark.createDataFrame(rows, "sample_id bigint, param string, value double")
    declared = spark.createDataFrame([("a", True, None), ("b", True, None), ("r", False, 4.0)], "name string, is_free boolean, value double")
    got = posterior.resolve_params(samples, declared, ["sample_id"])
    assert sorted((str(r.sample_id), r.value) for r in got.filter("param = 'r'").collect()) == [("1", 4.0), ("2", 4.0), ("None", 4.0)]
    assert "REPARTITION_BY_NUM" in plan(got) and got.count() == 11


def test_rows_of_large_groups_are_made_once_for_all_rounds(spark, monkeypatch):
    kept, real = [], ranks.staged
    monkeypatch.setattr(ranks, "staged", lambda df: (kept.append(df.columns), real(df))[1])
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 5000).cast("double").alias("v"))
    got = ranks.values_at_ranks(df, ["g"], "v", {"first": F.lit(0.0), "mid": F.col("n") / 2}, array_values=100)
    assert {(r.g, r.first, r.mid, r.n) for r in got.collect()} == {(0, 0.0, 2500.0, 2500), (1, 1.0, 2501.0, 2500)}
    assert kept.count(["g", "__v"]) == 1
