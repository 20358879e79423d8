"""The chunked ways along an axis give what the plain windows give."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxframe.operators import grids, layers, loo, posterior
from fluxframe.operators.axis import chunk_span, nearest_known, neighbours, running_total
from fluxframe.operators.groups import order_statistics, quantiles


@pytest.fixture(scope="module")
def series(spark):
    """One hot series with a third of the rows, clumps, gaps and a one-row series."""
    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("hot", 400), ("a", 150), ("b", 30), ("one", 1)):
        x = np.sort(rng.choice(np.arange(0, 5000), size=n, replace=False)) / 7.0
        x[n // 2:] += 300.0
        for i, v in enumerate(x):
            rows.append((key, float(v), float(rng.normal()), None if rng.random() < 0.6 else float(i)))
    return spark.createDataFrame(rows, "k string, x double, y double, z double").cache()


def frame(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def same(a, b):
    assert list(a.columns) == list(b.columns)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c], b[c], rtol=1e-11, atol=1e-11, equal_nan=True)
        else:
            assert a[c].tolist() == b[c].tolist()


@pytest.mark.parametrize("span", [3.0, 40.0, 2000.0, 0.01])
def test_neighbours(series, span):
    wanted = {"n1": ("y", 1), "n2": ("x", 2), "p1": ("y", -1), "p3": ("x", -3)}
    plain = neighbours(series, ["k"], "x", wanted, span=None)
    same(frame(neighbours(series, ["k"], "x", wanted, span=span), "k", "x"), frame(plain, "k", "x"))


@pytest.mark.parametrize("span", [3.0, 40.0, 2000.0])
@pytest.mark.parametrize("descending", [False, True])
def test_running_total(series, span, descending):
    plain = running_total(series, ["k"], "x", {"s": "y", "t": "z"}, descending=descending, span=None)
    got = running_total(series, ["k"], "x", {"s": "y", "t": "z"}, descending=descending, span=span)
    same(frame(got, "k", "x"), frame(plain, "k", "x"))


@pytest.mark.parametrize("span", [3.0, 40.0, 2000.0])
@pytest.mark.parametrize("after", [False, True])
def test_nearest_known(series, span, after):
    plain = nearest_known(series, ["k"], "x", {"w": "z"}, after=after, span=None)
    same(frame(nearest_known(series, ["k"], "x", {"w": "z"}, after=after, span=span), "k", "x"), frame(plain, "k", "x"))


def test_span_follows_group_size(series):
    assert chunk_span(series, ["k"], "x", rows_per_chunk=1000) is None
    span = chunk_span(series, ["k"], "x", rows_per_chunk=50)
    counts = series.groupBy("k", F.floor(F.col("x") / span)).count().agg(F.max("count")).first()[0]
    assert counts <= 100


def test_span_cuts_clumps(spark):
    clump = spark.range(1000).select(F.lit("k").alias("k"), (F.col("id") / 1e6).alias("x"))
    wide = clump.unionByName(spark.range(100).select(F.lit("k").alias("k"), (F.col("id") * 1e3 + 5).alias("x")))
    span = chunk_span(wide, ["k"], "x", rows_per_chunk=50)
    assert wide.groupBy(F.floor(F.col("x") / span)).count().agg(F.max("count")).first()[0] <= 100
    tied = spark.range(500).select(F.lit("k").alias("k"), F.when(F.col("id") < 400, 1.0).otherwise(F.col("id").cast("double")).alias("x"))
    assert chunk_span(tied, ["k"], "x", rows_per_chunk=50) > 0


@pytest.mark.parametrize("span", [None, 0.3, 5.0])
def test_exact_quantiles(series, span):
    got = {r["k"]: r for r in quantiles(series, ["k"], "y", {"lo": 0.159, "mid": 0.5, "top": 1.0}, span).collect()}
    for key, part in series.toPandas().groupby("k"):
        np.testing.assert_allclose([got[key][c] for c in ("lo", "mid", "top")], np.quantile(part["y"], [0.159, 0.5, 1.0]), rtol=1e-12)


def test_order_statistics_with_ties(spark):
    df = spark.createDataFrame([("a", float(v // 10)) for v in range(95)], "k string, v double")
    got = order_statistics(df, ["k"], "v", {"third": F.lit(2.0), "last": F.col("n") - 1}, span=2.0).first()
    assert (got["third"], got["last"], got["n"]) == (0.0, 9.0, 95)


@pytest.mark.parametrize("span", [None, 10.0])
@pytest.mark.parametrize("outside", ["clamp", "null"])
def test_interpolation_matches_numpy(spark, series, span, outside):
    points = series.select("k").distinct().withColumn("i", F.explode(F.sequence(F.lit(-3), F.lit(60)))).select("k", (F.col("i") * 18.5).alias("x"), "i")
    got = grids.interp_join(points, series, ["k"], "x", "y", outside=outside, span=span).toPandas()
    for key, part in series.toPandas().groupby("k"):
        part = part.sort_values("x")
        mine = got[got.k == key].sort_values("x")
        ends = {} if outside == "clamp" else {"left": np.nan, "right": np.nan}
        np.testing.assert_allclose(mine["y"].to_numpy(float), np.interp(mine["x"], part["x"], part["y"], **ends), rtol=1e-10, atol=1e-12)


def test_rebin_chunked_and_plain(spark, series):
    bins = spark.range(20).select((F.col("id") * 50.0 + 20).alias("x"), F.lit(35.0).alias("w"))
    args = dict(target_by=[], target="x", widths="w", strict=False)
    big = series.filter("k <> 'one'")
    a = grids.rebin(big, bins, ["k"], "x", "y", span=None, bucket=60.0, **args)
    b = grids.rebin(big, bins, ["k"], "x", "y", span=20.0, bucket=7.0, **args)
    same(frame(a, "k", "x"), frame(b, "k", "x"))


def test_layer_operators_chunked(spark, series):
    cols = series.filter("k <> 'one'").select("k", (F.col("x") + 1).alias("pressure"), F.abs("y").alias("kappa"), (F.lit(1.0) + F.abs("y")).alias("density"))
    for fn in (
        lambda s: layers.cumulative_trapz(cols, ["k"], span=s).select("k", "pressure", "tau"),
        lambda s: layers.hydrostatic_radius(cols, ["k"], 100.0, 2.0, 1e4, span=s).select("k", "pressure", "radius"),
        lambda s: layers.hydrostatic_radius(cols, ["k"], 100.0, 2.0, 1e4, variable_gravity=False, span=s).select("k", "pressure", "radius"),
    ):
        same(frame(fn(None), "k", "pressure"), frame(fn(25.0), "k", "pressure"))


def test_sampling_is_reproducible_and_whole(spark):
    df = spark.createDataFrame([("r", i, float(i)) for i in range(50)], "run_id string, sample_id bigint, p double")
    one = frame(posterior.sample_posterior(df, 300, 11), "draw")
    two = frame(posterior.sample_posterior(df, 300, 11, span=7.0), "draw")
    assert len(one) == 300 and one["sample_id"].nunique() > 40
    assert one["sample_id"].tolist() == two["sample_id"].tolist()


def reference_loo(ll):
    """Dense Pareto-smoothed LOO of one point in plain numpy."""
    lw = -np.asarray(ll)
    x = lw - lw.max()
    n = len(x)
    cut = np.sort(x)[-int(np.ceil(min(0.2 * n, 3 * math.sqrt(n)))) - 1]
    tail = np.where(x > cut)[0]
    order = tail[np.argsort(x[tail])]
    k = math.inf
    if len(tail) > 4:
        k, sigma = loo.fit_tail(np.exp(x[order]) - math.exp(cut))
        if k >= 1 / 3:
            p = (np.arange(len(tail)) + 0.5) / len(tail)
            x[order] = np.log(sigma * np.expm1(-k * np.log1p(-p)) / k + math.exp(cut))
            x[x > 0] = 0
    x -= np.log(np.exp(x).sum())
    return np.log(np.exp(x + np.asarray(ll)).sum()), k


@pytest.mark.parametrize("span", [None, 0.5])
def test_psis_matches_dense_kernel(spark, span):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(4, 700)) * np.array([0.3, 1.0, 2.0, 4.0])[:, None] - 2
    rows = [(i, j, float(v)) for i in range(4) for j, v in enumerate(values[i])]
    df = spark.createDataFrame(rows, "point_id bigint, sample_id bigint, log_lik double")
    got = {r["point_id"]: r for r in loo.psis_loo(df, ["point_id"], span=span).collect()}
    for i in range(4):
        elpd, k = reference_loo(values[i])
        assert got[i]["elpd"] == pytest.approx(elpd, rel=1e-9)
        assert got[i]["pareto_k"] == pytest.approx(k, rel=1e-9)


def test_tail_fit_recovers_shape():
    rng = np.random.default_rng(1)
    shape, scale = 0.4, 2.0
    sample = np.sort(scale / shape * ((1 - rng.random(20000)) ** -shape - 1))
    k, sigma = loo.fit_tail(sample)
    assert k == pytest.approx(shape, abs=0.03) and sigma == pytest.approx(scale, rel=0.05)
