import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text of the smallest table."""
    rows = duckdb.connect().execute(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    return dict(rows)


AWKWARD = [
    (1, "one two three four five six seven", "a"), (1, "one two three four five six seven", "a"), (None, "one two three four five six seven", None),
    (2, None, "b"), (3, "", "b"), (4, " \t\n ", "c"), (5, "short", "c"), (6, "x" * 5000, "d"), (7, "mail me a.b@c.example.org now", "d"),
    (8, "w " * 20000, "e"), (9, "日本語のテキスト " * 3, "e"), (10, "a <|endoftext|> b  c\n\nd", None),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """NULLs, empty and long texts, repeated rows, columns whose names clash with working ones."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, key string")
    return df.selectExpr("doc_id", "text", "key", "key AS node", "key AS part", "key AS spans", "key AS row", "key AS n", "key AS score", "key AS slot")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.filter("false")
