"""Run registered queries beside their SQL and compare: python tools/check.py sf_dir [name part ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fluxframe.plans import QUERIES, SQL  # noqa: E402
from fluxframe.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET threads=4")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _close(a, b, loose: bool) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (loose and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))
    return a == b


def compare(spark, con, name: str, sf: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    pdf = df.select(*cols).toArrow()
    took = time.time() - start
    got = sorted((tuple(_plain(v) for v in r) for r in zip(*[pdf[c].to_pylist() for c in cols])), key=repr)
    if name not in SQL:
        return len(got) > 0, f"{len(got)} rows only, {took:.1f}s"
    start = time.time()
    res = con.execute(SQL[name])
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return False, f"columns {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in res.fetchall()), key=repr)
    info = f"{len(got)} rows, spark {took:.1f}s, sql {time.time() - start:.1f}s"
    if len(got) != len(want):
        return False, f"{info}; sql has {len(want)} rows; first {got[:1]} / {want[:1]}"
    exact = got == want
    if exact:
        return bool(got), info if got else "no rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    near = all(all(_close(x, y, True) for x, y in zip(a, b)) for a, b in bad)
    return False, f"{info}; {len(bad)} rows differ ({'only by rounding' if near else 'really'}): {bad[0]}"


def main() -> int:
    sf, parts = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sf)
    failed = []
    for name in QUERIES:
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, info = compare(spark, con, name, sf)
        except Exception as e:  # report and go on with the next query
            ok, info = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, info, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
