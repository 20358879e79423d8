"""Every registered query beside its SQL on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from fluxframe.plans import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("check", ROOT / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, info = check.compare(spark, con, name, SF)
    assert ok, info


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_target_grids_reach_all_events(spark, tmp_path):
    """Events before and after the 30 days that the grids have at least; the SQL follows them as well."""
    rows = [(u, f"{day} 03:00:00", 2.0) for u in (1, 2) for day in ("2023-12-30", "2024-01-15", "2024-03-10")]
    spark.createDataFrame(rows, "user_id long, ts string, value double").selectExpr("user_id", "CAST(ts AS timestamp_ntz) AS ts", "value").write.parquet(str(tmp_path / "events.parquet"))
    days = QUERIES["d1_rebin_daily"](spark, str(tmp_path)).collect()
    assert sorted((r.series_id, r.x / 86400 - 0.5) for r in days) == [(u, float(d)) for u in (1, 2) for d in range(-2, 70)]
    assert all(r.y == 2.0 for r in days if -1 <= r.x / 86400 - 0.5 <= 68)
    points = QUERIES["d2_interpolation_join"](spark, str(tmp_path)).collect()
    assert sorted((r.series_id, r.x / 21600) for r in points) == [(u, float(i)) for u in (1, 2) for i in range(-8, 278)]
    assert all(r.y_clamped == 2.0 for r in points) and sum(r.y_inside is not None for r in points) == 2 * 284
    own = duckdb.connect()
    own.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("d1_rebin_daily", "d2_interpolation_join"):
        ok, info = check.compare(spark, own, name, str(tmp_path))
        assert ok, info
