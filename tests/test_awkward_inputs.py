"""Masked, constant, unknown and missing input."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxframe.operators import axis, chemistry, detrend, fitting, grids, groups, lookup, posterior, smooth


def test_chunked_path_keeps_null_and_infinite_rows(spark):
    rows = [("a", float(i), float(i)) for i in range(8)] + [("a", None, 1.0), (None, 1.0, 2.0), ("a", float("-inf"), 3.0), ("a", float("nan"), 4.0), ("a", math.inf, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    assert axis.chunk_span(df, ["g"], "x", rows_per_chunk=2) is not None
    for span in (None, 2.0):
        got = axis.running_total(df, ["g"], "x", {"t": "y"}, span=span).collect()
        assert len(got) == len(rows)
        near = axis.nearest_known(df, ["g"], "x", {"last": "y"}, span=span)
        assert near.count() == len(rows)
    plain = axis.running_total(df, ["g"], "x", {"t": "y"}, span=None)
    cut = axis.running_total(df, ["g"], "x", {"t": "y"}, span=2.0)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_group_statistics_keep_null_keys(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "g string, v double")
    got = groups.with_group_stats(df, ["g"], {"m": F.avg("v")}).collect()
    assert sorted((r.v, r.m) for r in got) == [(1.0, 2.0), (3.0, 2.0), (5.0, 6.0), (7.0, 6.0)]


def masked(spark):
    return spark.createDataFrame([("s", float(i), None if i == 4 else 1.0) for i in range(10)], "s string, wavelength double, flux double")


def test_integrals_and_bands_skip_masked_points(spark):
    df = masked(spark)
    assert grids.trapezoid_integral(df, ["s"], "wavelength", "flux").first()["integral"] == pytest.approx(9.0)
    assert grids.left_integral(df, ["s"], "wavelength", "flux").first()["integral"] == pytest.approx(9.0)
    bands = spark.createDataFrame([("whole", 1.0, 8.0), ("known", 5.5, 8.0)], "band string, w_low double, w_high double")
    got = {r.band: r.flux for r in grids.band_average(df, bands, ["s"]).collect()}
    assert got["whole"] is None and got["known"] == pytest.approx(1.0)


def test_full_smoothing_skips_masked_points_and_keeps_copies(spark):
    df = masked(spark).filter("wavelength > 0")
    got = smooth.gauss_smooth_full(df.union(df.limit(1)), ["s"], "wavelength", "flux", 3.0).collect()
    assert len(got) == 10 and all(r.smooth == pytest.approx(1.0) for r in got)


def test_constant_groups(spark):
    df = spark.createDataFrame([("a", 2.0)] * 4, "g string, value double")
    (row,) = posterior.hist1d(df, ["g"], bins=5).collect()
    assert row.n == 4 and row.bin == 2 and row.density == pytest.approx(5.0)
    assert {r.scaled for r in grids.min_max_scale(df, ["g"], "value").collect()} == {0.0}


def test_sysrem_with_a_masked_channel(spark):
    rows = [(0, e, c, 0.1 if c == 2 else 1.0 + 0.01 * e * c, 0.1, 1.0 + 0.1 * e, 1.0 + 0.01 * c) for e in range(4) for c in range(5)]
    df = spark.createDataFrame(rows, "order_id long, exposure_id long, channel long, flux double, uncertainty double, airmass double, wavelength double")
    got = detrend.sysrem(df, passes=1, max_iterations=2, epsilon=0.0).collect()
    assert len(got) == len(rows)


def test_unknown_species_are_not_dropped(spark):
    layers = spark.createDataFrame([(0, 0, "H2", 0.9), (0, 0, "XX", 0.1)], "col_id long, layer long, species string, mass_fraction double")
    masses = spark.createDataFrame([("H2", 2.0)], "species string, molar_mass double")
    with pytest.raises(Exception, match="no molar mass"):
        chemistry.mean_molar_mass(layers, masses, by=["col_id", "layer"]).collect()
    cross = spark.createDataFrame([("H2", 1.0), ("XX", 1.0)], "species string, cross_section double")
    assert {r.species: r.kappa is None for r in lookup.to_mass_opacity(cross, masses).collect()} == {"H2": False, "XX": True}


def test_lookup_keeps_points_without_a_coordinate(spark):
    grid = spark.createDataFrame([(float(t), float(p), float(t + p)) for t in range(3) for p in range(3)], "temperature double, pressure double, v double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 1.0)], "id long, t double, p double")
    got = {r.id: r.value for r in lookup.grid_lookup(points, grid, [lookup.Axis("temperature", "t"), lookup.Axis("pressure", "p")], "v").collect()}
    assert got == {1: pytest.approx(1.0), 2: None}


def test_widths_per_group_and_masked_points(spark):
    """Blocks of any size give one result; NULL keys are a group; masked points have no weight; a NULL width changes nothing."""
    rng = np.random.default_rng(2)
    rows = [(g, i, None if (i + (g or 0)) % 11 == 4 else float(rng.normal()), s) for g, n, s in ((1, 40, 0.8), (2, 300, 12.0), (None, 25, 3.0), (3, 5, None), (4, 1, 2.0)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, y double, s double").withColumn("row", F.lit("x"))
    for edge in ("nearest", "reflect"):
        want = {}
        for g in (1, 2, None, 3, 4):
            y = np.array([np.nan if r[2] is None else r[2] for r in rows if r[0] == g])
            s = next(r[3] for r in rows if r[0] == g)
            radius = int(4 * s + 0.5) if s else 0
            for i in range(len(y)):
                at = np.arange(i - radius, i + radius + 1)
                n = len(y)
                inside = np.clip(at, 0, n - 1) if edge == "nearest" else np.where(at % (2 * n) < n, at % (2 * n), 2 * n - 1 - at % (2 * n))
                w = np.exp(-0.5 * ((at - i) / s) ** 2) if radius else np.ones(1)
                known = ~np.isnan(y[inside])
                want[g, i] = (w[known] * y[inside][known]).sum() / w[known].sum() if known.any() else None
        for block in (1, 7, 8192):
            got = smooth.gauss_smooth(df, ["g"], "i", "y", "s", edge, block=block)
            assert got.columns == [*df.columns, "smooth"]
            assert {(r.g, r.i): r.smooth for r in got.collect()} == pytest.approx(want)


def test_resolution_per_group(spark):
    x = np.exp(np.linspace(0, 0.4, 200))
    rows = [(g, float(v), float(np.sin(30 * v)), r) for g, r in (("a", 50.0), ("b", 200.0), ("c", None)) for v in x]
    df = spark.createDataFrame(rows, "g string, wavelength double, flux double, r double")
    got = {(r.g, r.wavelength): r.flux for r in smooth.convolve_to_resolution(df, ["g"], "r").collect()}
    step = np.mean(2 * np.diff(x) / (x[1:] + x[:-1]))
    for g, power in (("a", 50.0), ("b", 200.0)):
        sigma = 1 / power / smooth.FWHM / step
        k = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
        w = np.exp(-0.5 * (k / sigma) ** 2)
        y = np.sin(30 * x)
        want = [(w * y[np.clip(i + k, 0, len(x) - 1)]).sum() / w.sum() for i in range(len(x))]
        assert [got[g, float(v)] for v in x] == pytest.approx(want)
    assert all(got["c", float(v)] == pytest.approx(np.sin(30 * v)) for v in x)


def test_masked_points_of_a_boxcar(spark):
    rows = [(1, i, None if i == 4 else float(i)) for i in range(9)]
    got = {r.i: r.smooth for r in smooth.boxcar(spark.createDataFrame(rows, "g long, i long, y double"), ["g"], "i", "y", 4).collect()}
    assert got[4] == pytest.approx((2 + 3 + 5) / 3) and all(v is not None for v in got.values())


def test_fit_chain_on_awkward_inputs(spark):
    """A scale factor that is missing, a masked model point and a NULL extra score; a kernel that gives two models."""
    def kernel(batch):
        rows = []
        for sample in batch.column("sample_id").to_pylist():
            x = [1.0, 2.0, 3.0, 4.0]
            rows.append((sample, "m", 0, None, x, [1.0, 1.0, None if sample == 3 else 1.0, 1.0], None))
            rows.append((sample, "n", 0, 2.0, x, [0.5] * 4, -1.0))
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["sample_id", "model", "column_id", "column_weight", "wavelength", "flux", "extra_log_l"])

    parameters = spark.createDataFrame([(1,), (2,), (3,)], "sample_id long")
    models = fitting.model_spectra(parameters, kernel)
    data = spark.createDataFrame([(d, w, 1.0, 2.0, 1.0) for d in ("p", "q") for w in (2.0, 3.0)], "dataset string, wavelength double, bin_width double, flux double, uncertainty double")
    datasets = spark.createDataFrame([("p", "m", "grid", True), ("q", "n", "grid", None)], "dataset string, source string, kind string, scaled boolean")
    names = spark.createDataFrame([(1, "p_scale_factor", 0.5), (3, "p_scale_factor", 0.5)], "sample_id long, name string, value double")
    per = fitting.score_models(models, data, datasets, names)
    got = {(r.sample_id, r.dataset): r.log_l for r in per.collect()}
    flat = -math.log(2 * math.pi)
    assert got[1, "p"] == pytest.approx(flat) and got[2, "p"] is None and got[3, "p"] is None
    assert all(got[s, "q"] == pytest.approx(flat - 1.0) for s in (1, 2, 3))
    total = {r.sample_id: r.log_l for r in fitting.total_score(per, models).collect()}
    assert total[1] == pytest.approx(2 * flat - 2.0) and total[2] < -1e90 and total[3] < -1e90
    with pytest.raises(ValueError):
        fitting.observed_models(models, data, datasets.withColumn("kind", F.lit("image")))


def test_quantiles_are_the_same_at_every_size(spark):
    """NULL keys, NaN, infinite values, ties: the way for large groups gives what ``percentile`` gives."""
    values = [(g, v) for g in ("a", None) for v in (float("nan"), -math.inf, 1.0, 5.0, 5.0, 5.0, math.inf)] + [("b", 1.0), ("b", None), ("c", -math.inf), ("c", 2.0), ("d", 3.0)]
    df = spark.createDataFrame(values, "g string, v double")
    qs = {"low": 0.0, "some": 0.3, "mid": 0.5, "most": 0.9, "top": 1.0}
    plain = {r.g: tuple(r)[1:] for r in groups.quantiles(df, ["g"], "v", qs).collect()}
    for span in (None, 2.0):
        got = {r.g: tuple(r)[1:] for r in groups.quantiles(df, ["g"], "v", qs, span=span).collect()}
        assert set(got) == set(plain) == {"a", "b", "c", "d", None}
        for g in plain:
            assert got[g] == pytest.approx(plain[g], nan_ok=True), (g, span)
