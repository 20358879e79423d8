"""Values at ranks are those of a full sort, for groups that are narrowed in rounds as well."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxframe.operators import groups
from fluxframe.operators.ranks import values_at_ranks

def ranks():
    return {"first": F.lit(0), "third": F.lit(2), "half": F.floor(F.col("n") / 2), "late": F.col("n") * 0.997, "last": F.col("n") - 1, "beyond": F.col("n"), "before": F.lit(-1)}


def at(values, r):
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    r = math.floor(r)
    return v[r] if 0 <= r < len(v) else None


def want(values):
    n = sum(x is not None for x in values)
    return [at(values, r) for r in (0, 2, n // 2, n * 0.997, n - 1, n, -1)] + [n]


def same(got, values):
    for g, w in zip(got, want(values)):
        assert g == w or (isinstance(w, float) and math.isnan(w) and math.isnan(g)), (got, want(values))


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(11)
    huge = 10.0 ** rng.uniform(-300, 300, 4000)  # no even grid would part these
    tied = np.where(rng.random(5000) < 0.9, 1.5, rng.normal(size=5000))
    odd = [*rng.normal(size=3000).tolist(), *[math.nan] * 500, *[math.inf] * 300, *[-math.inf] * 300, *[None] * 200]
    return {"huge": huge.tolist(), "tied": tied.tolist(), None: odd, "same": [2.5] * 3000, "few": [3.0, -0.0, 0.0, math.nan], "one": [7.0], "none": [None, None],
            "nan": [math.nan] * 2500, "shuffled": rng.permutation(6000).astype(float).tolist()}


@pytest.mark.parametrize("limit", [4, 20, 1_000_000])
def test_any_group_at_any_limit(spark, samples, limit):
    df = spark.createDataFrame([(k, v, "x") for k, vs in samples.items() for v in vs], "k string, v double, n string").repartition(7)
    got = {r[0]: tuple(r)[1:] for r in values_at_ranks(df, ["k"], "v", ranks(), limit).collect()}
    assert got.keys() == samples.keys()
    for k, vs in samples.items():
        same(got[k], vs)


@pytest.mark.parametrize("limit", [50, 100_000])
def test_whole_numbers_and_no_group(spark, limit):
    values = [(1 << 30) + i % 701 for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    r = values_at_ranks(df, [], "v", {"low": F.lit(5), "top": F.col("n") - 1}, limit).collect()
    assert [tuple(x) for x in r] == [(sorted(values)[5], max(values), 3000)]
    assert values_at_ranks(df.filter("false"), [], "v", {"low": F.lit(0)}, limit).count() == 0


def test_types_that_doubles_do_not_hold(spark):
    big = [(1 << 60) + i % 701 for i in range(3000)]  # doubles would run these together
    df = spark.createDataFrame([(v,) for v in big], "v long")
    with pytest.raises(TypeError):
        values_at_ranks(df, [], "v", {"low": F.lit(5)})
    assert groups.order_statistics(df, [], "v", {"low": F.lit(5), "top": F.col("n") - 1}).first()[:2] == (sorted(big)[5], max(big))


def test_quantiles_are_those_of_the_builtin(spark, samples):
    df = spark.createDataFrame([(k, v) for k, vs in samples.items() for v in vs if v is None or not math.isnan(v)], "k string, v double")
    qs = {"a": 0.0, "b": 0.159, "c": 0.5, "d": 0.9973, "e": 1.0}
    got = {r[0]: tuple(r)[1:] for r in groups.quantiles(df, ["k"], "v", qs).collect()}
    plain = {r[0]: tuple(r)[1:] for r in df.groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in qs.items()]).collect()}
    assert got.keys() == plain.keys()
    for k in plain:
        assert all(a == b or a == pytest.approx(b, rel=1e-12) for a, b in zip(got[k], plain[k], strict=True)), k


def test_rows_meet_no_sort_or_window(spark, samples):
    """The plan sorts arrays of bounded size only: no window over a group, no range exchange."""
    df = spark.createDataFrame([("huge", v) for v in samples["huge"]], "k string, v double")
    plan = values_at_ranks(df, ["k"], "v", ranks(), 100)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan
