"""Operators on inputs whose result is known."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxframe.functions import constants as k
from fluxframe.functions import orbits, physics, priors, solar, stats
from fluxframe.operators import catalog, chemistry, correlate, covariance, detrend, fits, grids, layers, lookup, observe, posterior, profiles, score, smooth
from fluxframe.sources import tables, text


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("v")).first()["v"]


def test_planck_against_direct_formula(spark):
    for t, w in ((500.0, 1e-4), (1500.0, 1e-3), (5000.0, 5e-5)):
        want = 2 * k.H * k.C**2 / w**5 / (math.exp(k.H * k.C / (w * k.KB * t)) - 1)
        assert one(spark, physics.planck_cm("t", "w"), t=t, w=w) == pytest.approx(want, rel=1e-12)
        nu = k.C / w
        numeric = (one(spark, physics.planck_hz("t", "n"), t=t * 1.0001, n=nu) - one(spark, physics.planck_hz("t", "n"), t=t * 0.9999, n=nu)) / (2e-4 * t)
        assert one(spark, physics.planck_hz_dt("t", "n"), t=t, n=nu) == pytest.approx(numeric, rel=1e-5)


def test_light_loss_branches(spark):
    def loss(p, z):
        return one(spark, orbits.uniform_light_loss("p", "z"), p=p, z=z)

    assert loss(0.1, 0.0) == pytest.approx(0.01)
    assert loss(0.1, 1.2) == 0.0
    assert loss(2.0, 0.5) == 1.0
    assert 0 < loss(0.1, 1.0) < 0.01
    assert loss(1.0, 1e-9) == pytest.approx(1.0, abs=1e-6)


def test_phase_rule(spark):
    values = [one(spark, orbits.orbital_phase("t", 2.0), t=t) for t in (0.0, 1.0, 5.0, -0.5, -2.0)]
    assert values == pytest.approx([0.0, 0.5, 0.5, -0.25, -1.0])


def test_normal_quantile(spark):
    dist = NormalDist()
    ps = [1e-300, 1e-20, 1e-9, 0.01, 0.074, 0.2, 0.5, 0.77, 0.93, 0.999, 1 - 1e-12]
    got = [r["v"] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(priors.normal_quantile("p").alias("v")).collect()]
    assert got == pytest.approx([dist.inv_cdf(p) for p in ps], rel=1e-9)
    assert one(spark, priors.normal_quantile("p"), p=1.5) is None


def test_prior_kinds_and_flags(spark):
    rows = [("a", "gaussian", 1.0, 2.0), ("b", "log_gaussian", 3.0, 0.5), ("c", "log", -2.0, 2.0)]
    table = spark.createDataFrame(rows, "name string, prior_type string, prior_a double, prior_b double")
    draws = spark.createDataFrame([("a", 0.8413447460685429), ("b", 0.5), ("c", 0.5)], "name string, u double")
    got = {r["name"]: r["value"] for r in posterior.prior_transform(draws, table).collect()}
    assert got == pytest.approx({"a": 3.0, "b": 3.0 * math.exp(0.25), "c": 1.0}, rel=1e-9)
    assert one(spark, priors.range_flag("x", 0.0, 1.0), x=2.0) == -math.inf
    assert one(spark, priors.upper_bound_flag("x", 1.0), x=0.5) == 0.0


def test_bayes_factor_significance(spark):
    got = [one(spark, stats.bayes_factor_to_sigma("b"), b=b) for b in (1.0, 3.0, 12.0, 150.0, 1e10, 1e12)]
    assert got[0] == pytest.approx(NormalDist().inv_cdf(1 - math.exp(-1) / 2), rel=1e-6)
    assert one(spark, stats.bayes_factor_to_sigma("b"), b=0.5) is None
    assert got[2] == pytest.approx(2.7, abs=0.05) and got[3] == pytest.approx(3.6, abs=0.05)
    assert got == sorted(got)
    for s in (1.5, 3.0, 5.0):
        b = one(spark, stats.sigma_to_bayes_factor("s"), s=s)
        assert one(spark, stats.bayes_factor_to_sigma("b"), b=b) == pytest.approx(s, rel=1e-6)


def line(spark, n=40, groups=2, slope=0.5):
    rows = [(g, float(i), 1.0 + slope * i + g) for g in range(groups) for i in range(n)]
    return spark.createDataFrame(rows, "g int, x double, y double")


def test_rebin_of_a_line_is_exact(spark):
    targets = spark.createDataFrame([(5.3 + 2.7 * i,) for i in range(10)], "x double")
    got = grids.rebin(line(spark), targets, ["g"], "x", "y", target_by=[], target="x").toPandas()
    np.testing.assert_allclose(got["y"], 1 + got["g"] + 0.5 * (got["bin_low"] + got["bin_high"]) / 2, rtol=1e-12)
    assert len(got) == 20


def test_rebin_strict_fails_outside(spark):
    targets = spark.createDataFrame([(0.2,), (1.0,), (2.0,)], "x double")
    with pytest.raises(Exception, match="outer bin edges"):
        grids.rebin(line(spark), targets, ["g"], "x", "y", target_by=[], target="x").collect()
    single = spark.createDataFrame([(5.0, 1.0)], "x double, w double")
    with pytest.raises(Exception, match="fewer than two bins"):
        grids.rebin(line(spark), single, ["g"], "x", "y", target_by=[], target="x", widths="w").collect()


def test_interpolation_error_mode(spark):
    points = spark.createDataFrame([(0, 99.0)], "g int, x double")
    with pytest.raises(Exception, match="outside the knots"):
        grids.interp_join(points, line(spark), ["g"], "x", "y", outside="error").collect()


def test_generated_grids(spark):
    e = [r["wavelength"] for r in grids.grid_exp(spark, 1.0, 2.0, 10).orderBy("id").collect()]
    assert e[-2] < 2.0 <= e[-1] and e[1] / e[0] == pytest.approx(math.exp(0.1))
    m = [r["wavelength"] for r in grids.grid_mul(spark, 1.0, 2.0, 10).orderBy("id").collect()]
    assert m[-1] <= 2.0 < m[-1] * 1.1 and m[1] == pytest.approx(1.1)


def spectra(spark, flux, exposures=12, channels=30, orders=2):
    rows = [(o, e, c, 1.0 + 0.01 * c, 1.0 + 0.05 * e, float(flux(o, e, c)), 0.1) for o in range(orders) for e in range(exposures) for c in range(channels)]
    return spark.createDataFrame(rows, "order_id bigint, exposure_id bigint, channel bigint, wavelength double, airmass double, flux double, uncertainty double")


def test_fits_remove_exact_trends(spark):
    flat = detrend.remove_throughput_fit(spectra(spark, lambda o, e, c: 2 + e + 0.3 * c + 0.01 * c * c), 2).toPandas()
    np.testing.assert_allclose(flat["flux"], 1, rtol=1e-9)
    np.testing.assert_allclose(flat["uncertainty"] * (2 + flat["exposure_id"] + 0.3 * flat["channel"] + 0.01 * flat["channel"] ** 2), 0.1 * math.sqrt(27 / 30), rtol=1e-9)
    for degree in (1, 2):
        trend = spectra(spark, lambda o, e, c: math.exp(-0.1 - 0.02 * c * (1 + 0.05 * e) - (degree - 1) * (0.05 * e) ** 2))
        got = detrend.remove_tellurics_fit(trend, degree).toPandas()
        np.testing.assert_allclose(got["flux"], 1, rtol=1e-9)
    cubic = fits.with_poly_fit(spectra(spark, lambda o, e, c: c**3 - 2.0 * c), ["order_id", "exposure_id"], "wavelength", F.col("flux"), F.lit(1.0), 3)
    wrong = cubic.select(F.abs(F.col("__fit") - F.col("flux")).alias("d")).agg(F.max("d")).first()[0]
    assert wrong < 1e-6


def test_means_and_masks(spark):
    df = spectra(spark, lambda o, e, c: 1 + e).withColumn("flux", F.when((F.col("exposure_id") == 3) & (F.col("channel") < 29), None).otherwise(F.col("flux")))
    got = detrend.remove_throughput_mean(df).filter("flux IS NOT NULL").toPandas()
    np.testing.assert_allclose(got["flux"], 1)
    low = detrend.remove_tellurics_mean(spectra(spark, lambda o, e, c: 0.01 if c == 4 else 1.0), threshold=0.5).toPandas()
    assert low[low.channel == 4]["flux"].isna().all() and low[low.channel != 4]["flux"].notna().all()
    fully = df.withColumn("flux", F.when(F.col("exposure_id") == 5, None).otherwise(F.col("flux")))
    kept = detrend.remove_throughput_fit(fully, 2)
    assert kept.count() == df.count()


def test_sysrem_takes_a_rank_one_matrix(spark):
    df = spectra(spark, lambda o, e, c: (1 + 0.1 * e) * (2 + math.sin(c)))
    got = detrend.sysrem(df, 1, 10, 1e-6, threshold=None, remove_mean=False).toPandas()
    assert np.nanmax(np.abs(got["flux"])) < 1e-9
    ratio = detrend.sysrem(df, 1, 5, 0.0, subtract=False, threshold=None).toPandas()
    np.testing.assert_allclose(ratio["flux"], 1, rtol=1e-9)


def test_sysrem_matches_numpy(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(size=(2, 12, 30)) * 0.1
    df = spectra(spark, lambda o, e, c: (1 + 0.1 * e) * (2 + math.sin(c)) + noise[o, e, c])
    got = detrend.sysrem(df, 2, 4, 0.0, threshold=None, remove_mean=True).toPandas().sort_values(["order_id", "exposure_id", "channel"])
    cube = np.array(df.toPandas().sort_values(["order_id", "exposure_id", "channel"])["flux"]).reshape(2, 12, 30)
    work = cube - cube.mean(axis=2, keepdims=True)
    for _ in range(2):
        a = np.ones((2, 12))
        for _ in range(4):
            c = np.einsum("oe,oec->oc", a, work) / (a**2).sum(axis=1)[:, None]
            a = np.einsum("oc,oec->oe", c, work) / (c**2).sum(axis=1)[:, None]
        work = work - a[:, :, None] * c[:, None, :]
    np.testing.assert_allclose(got["flux"].to_numpy(), work.ravel(), rtol=1e-7, atol=1e-10)


def test_self_correlation_is_one(spark):
    df = spectra(spark, lambda o, e, c: math.sin(c) + 2)
    model = df.filter("exposure_id = 0").select("order_id", "channel", "flux", F.lit(0).cast("bigint").alias("v_index"))
    got = correlate.cross_correlate(df, model, ["order_id", "channel"], ["order_id", "exposure_id"], normalize=True, model_by=["order_id", "v_index"]).toPandas()
    np.testing.assert_allclose(got["ccf"], 1, rtol=1e-12)


def test_gaussian_smoothing_of_constant(spark):
    df = spectra(spark, lambda o, e, c: 3.0)
    for edge in ("nearest", "reflect"):
        got = smooth.gauss_smooth(df, ["order_id", "exposure_id"], "channel", "flux", 2.5, edge, block=16).toPandas()
        np.testing.assert_allclose(got["smooth"], 3.0, rtol=1e-12)
        assert len(got) == 2 * 12 * 30


def test_smoothing_blocks_do_not_matter(spark):
    df = spectra(spark, lambda o, e, c: math.sin(c * c) + 2, exposures=2, channels=200)
    keys = ["order_id", "exposure_id", "channel"]
    for edge in ("nearest", "reflect"):
        a, b = (smooth.gauss_smooth(df, keys[:2], "channel", "flux", 3.0, edge, block=n).toPandas().sort_values(keys) for n in (32, 8192))
        np.testing.assert_allclose(a["smooth"], b["smooth"], rtol=1e-12)
    a, b = (smooth.running_mean(df, keys[:2], "channel", "flux", 7, block=n).toPandas().sort_values(keys) for n in (16, 8192))
    np.testing.assert_allclose(a["mean"], b["mean"], rtol=1e-12)


def test_covariance_blocks(spark):
    rng = np.random.default_rng(2)
    matrices = {}
    for key, n in (("a", 11), ("b", 5), ("c", 3)):
        m = rng.normal(size=(n, n))
        matrices[key] = m @ m.T + n * np.eye(n)
    cells = [(key, i, j, float(m[i, j])) for key, m in matrices.items() for i in range(len(m)) for j in range(len(m))]
    cov = spark.createDataFrame(cells, "dataset string, i bigint, j bigint, c double")
    vectors = {(key, s): rng.normal(size=len(m)) for key, m in matrices.items() for s in range(3)}
    resid = spark.createDataFrame([(key, s, i, float(v)) for (key, s), d in vectors.items() for i, v in enumerate(d)], "dataset string, s bigint, i bigint, d double")
    for block in (4, 512):
        inverse, logdet = covariance.invert_covariance(cov, ["dataset"], block)
        got = {(r["dataset"], r["s"]): r["log_l"] for r in covariance.cov_loglik(resid, inverse, logdet, ["dataset"], ["s"], 1.5, block=block).collect()}
        point = {(r["dataset"], r["s"], r["i"]): r["log_lik"] for r in covariance.pointwise_cov_loglik(resid, inverse, ["dataset"], ["s"], block=block).collect()}
        for (key, s), d in vectors.items():
            c = matrices[key] * 1.5**2
            want = -0.5 * d @ np.linalg.inv(c) @ d - 0.5 * np.linalg.slogdet(2 * np.pi * c)[1]
            assert got[key, s] == pytest.approx(want, rel=1e-9)
            inv = np.linalg.inv(matrices[key])
            g = inv @ d
            for i in range(len(d)):
                assert point[key, s, i] == pytest.approx(0.5 * math.log(inv[i, i] / (2 * math.pi)) - 0.5 * g[i] ** 2 / inv[i, i], rel=1e-9)


def test_quantile_combination(spark):
    g = [(i + 0.5) / 16 for i in range(16)]
    a = [float(v) for v in range(16)]
    df = spark.createDataFrame([([a, [2.0] * 16],), ([a, [0.001] * 16],), ([a],), ([a, [1.0] * 16, [3.0] * 16],)], "parts array<array<double>>")
    got = [r["combined"] for r in layers.combine_quantiles(df, "parts", g, [1 / 16] * 16).collect()]
    np.testing.assert_allclose(got[0][1:-1], np.array(a)[1:-1] + 2, atol=0.6)
    assert got[2] == a
    assert np.mean(got[3]) == pytest.approx(np.mean(a) + 4, abs=0.2)


def test_hydrostatic_column_of_constant_density(spark):
    rows = [("c", float(p), 2.0) for p in range(1, 30)]
    df = spark.createDataFrame(rows, "k string, pressure double, density double")
    got = layers.hydrostatic_radius(df, ["k"], 10.0, 5.0, 1000.0, variable_gravity=False).toPandas()
    np.testing.assert_allclose(got["radius"], 1000 + (10 - got["pressure"]) / 2 / 5, rtol=1e-12)


def test_isothermal_pressure_from_radius(spark):
    gravity, radius, t, mu = 2000.0, 7e9, 1000.0, 2.3
    rows = [("c", radius * (1 + 0.0005 * i)) for i in range(20)]
    got = layers.pressure_from_radius(spark.createDataFrame(rows, "k string, radius double"), ["k"], 1.0, gravity, radius, lambda p: F.lit(t), lambda p: F.lit(mu)).toPandas()
    want = np.exp(mu * k.AMU * gravity * radius**2 / k.KB / t * (1 / got["radius"] - 1 / radius))
    np.testing.assert_allclose(got["pressure"], want, rtol=1e-9)


def test_lookup_is_exact_on_a_multilinear_table(spark):
    axes = {"x": [0.0, 1.0, 4.0], "y": [10.0, 20.0], "z": [-1.0, 0.0, 2.0, 3.0]}
    rows = [(x, y, z, 2 + x - 0.5 * y + 3 * z + x * y * z) for x in axes["x"] for y in axes["y"] for z in axes["z"]]
    grid = spark.createDataFrame(rows, "x double, y double, z double, v double")
    pts = spark.createDataFrame([(0.5, 12.0, 1.0), (4.0, 20.0, 3.0), (3.3, 19.0, -0.2)], "px double, py double, pz double")
    got = lookup.grid_lookup(pts, grid, [lookup.Axis("x", "px"), lookup.Axis("y", "py"), lookup.Axis("z", "pz")], "v").toPandas()
    np.testing.assert_allclose(got["value"], 2 + got.px - 0.5 * got.py + 3 * got.pz + got.px * got.py * got.pz, rtol=1e-12)


def test_filling_and_override_sum_to_one(spark):
    rows = [(1, 0, "H2O", 0.2), (1, 0, "CO", 0.1), (1, 0, "H2", 0.3), (1, 0, "Mg(s)", 0.5), (1, 1, "H2O", 0.9), (1, 1, "CO", 0.4)]
    df = spark.createDataFrame(rows, "col_id bigint, layer bigint, species string, mass_fraction double")
    filled = chemistry.fill_to_one(df.filter("layer = 0"), {"H2": 37.0, "He": 12.0}).toPandas()
    assert filled[~filled.species.str.contains("(s)", regex=False)]["mass_fraction"].sum() == pytest.approx(1)
    own = chemistry.fill_to_one(df.filter("layer = 0"), {"H2": None}).toPandas().set_index("species")["mass_fraction"]
    assert own["H2"] == pytest.approx(0.7)
    imposed = spark.createDataFrame([(1, 0, "CH4", 0.6), (1, 1, "CH4", 0.5)], "col_id bigint, layer bigint, species string, mass_fraction double")
    got = chemistry.override_abundances(df.filter("species NOT LIKE '%(s)'"), imposed, filling={"H2": 37.0, "He": 12.0}).toPandas()
    np.testing.assert_allclose(got.groupby("layer")["mass_fraction"].sum(), 1, rtol=1e-12)
    assert set(got[got.species == "CH4"]["mass_fraction"]) == {0.6, 0.5}
    with pytest.raises(ValueError):
        chemistry.fill_to_one(df, {"H2": None, "He": 1.0})


def test_solar_composition_has_solar_metallicity(spark):
    sun = solar.solar_abundances(spark)
    layer = sun.select(F.lit(1).alias("col_id"), F.lit(0).alias("layer"), "element", F.col("abundance").alias("amount"))
    assert chemistry.metallicity(layer, sun).first()["metallicity"] == pytest.approx(1)
    rel = [r["relative_to_solar"] for r in chemistry.hydrogen_ratios(layer, sun).collect()]
    np.testing.assert_allclose(rel, 1)


def test_electrons_count_as_hydrogen(spark):
    elements = spark.createDataFrame([("H2", "H", 2), ("e-", "X", 5)], "species string, element string, n bigint")
    vmr = spark.createDataFrame([(1, 0, "H2", 0.5), (1, 0, "e-", 0.25)], "col_id bigint, layer bigint, species string, volume_mixing_ratio double")
    got = chemistry.element_abundances(vmr, elements).collect()
    assert [(r["element"], r["amount"]) for r in got] == [("H", 1.25)]


def test_profiles(spark):
    base = spark.createDataFrame([(1,)], "sample_id bigint")
    df = profiles.over_pressures(base, -6.0, 3.0, 19)
    line = profiles.with_pchip(df, "log_pressure", [-6.0, -2.0, 0.0, 3.0], [-6.0, -2.0, 0.0, 3.0], "v").toPandas()
    np.testing.assert_allclose(line["v"], line["log_pressure"], atol=1e-12)
    grad = profiles.gradient_profile(profiles.over_pressures(base, -5.0, 3.0, 33), [0.2] * 6, 1000.0, ["sample_id"]).toPandas()
    want = 1000 * (np.maximum(grad["pressure"], 10**-3.0 ) / 1e3) ** 0.2
    np.testing.assert_allclose(grad["temperature"], want, rtol=1e-9)
    weights, breaks = profiles.quadratic_spline_weights([-3.0, -1.0, 0.0, 2.0, 3.0])
    x = 0.7
    piece = int(np.searchsorted(breaks, x, side="right")) - 1
    value = sum((n**2) * (c[0] + c[1] * x + c[2] * x * x) for n, c in zip([-3.0, -1.0, 0.0, 2.0, 3.0], weights[piece]))
    assert value == pytest.approx(x * x)


def test_scores(spark):
    df = spark.createDataFrame([("d", 1.0, 1.5, 0.5), ("d", 2.0, 2.0, 1.0)], "dataset string, flux double, model double, uncertainty double")
    got = score.chi2(df, ["dataset"], dof=1).first()
    assert (got["chi2"], got["reduced_chi2"]) == (1.0, 1.0)
    total = score.total_loglik(spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0)], "s int, log_l double"), ["s"]).collect()
    assert {r["s"]: r["log_l"] for r in total} == {1: -1e99, 2: 3.0}


def test_undeclared_parameter_is_an_error(spark):
    long = spark.createDataFrame([("r", 1, "p", 1.0)], "run_id string, sample_id bigint, param string, value double")
    table = spark.createDataFrame([("q", True, None)], "name string, is_free boolean, value double")
    with pytest.raises(ValueError, match="without declaration"):
        posterior.resolve_params(long, table, ["run_id", "sample_id"])


def test_best_measurement_rules(spark):
    rows = [("a", "m", 1.0, 0.3, -0.1, 1), ("a", "m", 2.0, 0.1, -0.1, 2), ("a", "m", 3.0, 0.1, -0.1, 3), ("b", "m", 5.0, None, None, 1), ("b", "m", None, None, None, 2),
            ("b", "m", 7.0, None, None, 3), ("c", "m", 9.0, None, None, 1)]
    df = spark.createDataFrame(rows, "entity_id string, parameter string, value double, err_upper double, err_lower double, source_order int")
    got = {r["entity_id"]: r["value"] for r in catalog.best_measurement(df).collect()}
    assert got == {"a": 2.0, "b": 7.0, "c": 9.0}


def test_catalog_names(spark):
    names = ["pl_name", "hostname", "pl_orbpererr1", "pl_orbsmaxlim", "pl_massj", "pl_bmassj", "st_lum", "sy_gaiamag", "sy_vmagerr1", "disc_year", "rastr", "pl_controv_flag", "st_refname", "sy_pmra"]
    df = spark.createDataFrame([tuple("1" for _ in names)], names)
    assert catalog.normalize_catalog(df).columns == [
        "name", "host_name", "orbital_period_error_upper", "orbit_semi_major_axis_limit_flag", "mass", "bmassj", "star_luminosity", "system_apparent_magnitude_gaia",
        "system_apparent_magnitude_v_error_upper", "discovery_year", "ra_str", "controversy_flag", "star_reference", "system_proper_motion_ra"]
    assert catalog.normalize_catalog(df, best_mass=True).columns[4:6] == ["massj", "mass"]


def test_readers(spark, tmp_path):
    (tmp_path / "three.dat").write_text("# wavelength flux sigma\n1.0 2.0 0.1\n\n1.1\t2.1  0.2 # note\n")
    (tmp_path / "four.csv").write_text("# # head\n1.0, 0.05, 2.0, 0.1\n1.1, 0.05, nan, 0.2\n")
    (tmp_path / "five.txt").write_text("1 2 3 4 5\n")
    (tmp_path / "two.txt").write_text("1 2\n")
    got = {r["dataset"]: r for r in text.read_spectra(spark, [str(tmp_path / n) for n in ("three.dat", "four.csv", "five.txt")]).orderBy("wavelength").collect()}
    assert got["three"]["flux"] == 2.1 and got["three"]["bin_width"] is None
    assert got["four"]["flux"] is None and got["four"]["bin_width"] == 0.05 and got["four"]["uncertainty"] == 0.2
    assert got["five"]["extra_columns"] and got["five"]["uncertainty"] == 3.0
    with pytest.raises(Exception, match="at least 3 columns"):
        text.read_spectra(spark, str(tmp_path / "two.txt")).collect()
    (tmp_path / "cat.tab").write_text("# origin\n#\npl_name\tpl_orbper\tst_teff\nx b\t2.5\t\n")
    row = text.read_catalog(spark, str(tmp_path / "cat.tab")).first()
    assert row["pl_name"] == "x b" and row["st_teff"] is None
    out = tmp_path / "out_PMN"
    out.mkdir()
    (out / "run_post_equal_weights.dat").write_text("  1.0  2.0  -3.5\n")
    (out / "run_params.json").write_text('["a", "b"]')
    row = text.read_posterior(spark, str(tmp_path), "run").first()
    assert (row["a"], row["b"], row["log_likelihood"]) == (1.0, 2.0, -3.5)


def test_partitioned_sink_prunes(spark, tmp_path):
    df = spark.range(200).select(F.concat(F.lit("s"), F.col("id") % 4).alias("species"), (F.col("id") / 100.0).alias("wavelength"), F.col("id").alias("kappa"))
    tables.write_table(df, str(tmp_path / "t"), ["species"], ["wavelength"], files_per_partition=2)
    got = tables.read_grid(spark, str(tmp_path / "t"), ["s1"], (0.5, 1.0))
    assert got.count() == 13 or got.count() == 12
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(species" in plan and "PushedFilters: [IsNotNull(wavelength)" in plan


def test_transit_chain_keeps_order(spark):
    seen = []

    def step(name):
        def run(df):
            seen.append(name)
            return df
        return run

    observe.observe(spark.range(1), {n: step(n) for n in ("rebin", "scale", "shift", "star")})
    assert seen == ["star", "scale", "shift", "rebin"]
    with pytest.raises(ValueError):
        observe.observe(spark.range(1), {"other": step("other")})


def test_derived_catalog_prefers_given_values(spark):
    cols = ["mass", "radius", "density", "axis", "star_radius", "star_teff", "star_age"]
    values = {"mass": k.M_JUP, "radius": None, "density": 1.33, "axis": k.AU, "star_radius": k.R_SUN, "star_teff": 5772.0, "star_age": 4.6e9 * k.YEAR}
    data = {c: values[c] for c in cols} | {f"{c}_{e}": 0.0 for c in cols for e in ("upper", "lower")} | {"star_mass": k.M_SUN}
    df = spark.createDataFrame([tuple(data.values())], ", ".join(f"{c} double" for c in data))
    got = catalog.derive_catalog(df).first()
    assert got["radius"] == pytest.approx((3 * k.M_JUP / (4 * math.pi * 1.33)) ** (1 / 3))
    assert got["t_eq"] == pytest.approx(5772 * math.sqrt(k.R_SUN / (2 * k.AU)))
    assert got["gravity"] == pytest.approx(k.G * k.M_JUP / got["radius"] ** 2)
