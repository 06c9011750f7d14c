from __future__ import annotations

import math
import os
import sys
from collections.abc import Callable
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Spark's Python workers
sys.path.insert(0, str(ROOT))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", f"file://{tmp_path_factory.mktemp('warehouse')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(SF, f"{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return db


def plain(v):
    """A value in a form that both engines share; numbers to nine digits."""
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def same_as_sql(spark: SparkSession, duck) -> Callable[[DataFrame, str], None]:
    """Asserts that a DataFrame's rows are those of a DuckDB statement, columns matched by name, order ignored."""

    def check(df: DataFrame, sql: str) -> None:
        got = duck.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(repr([plain(v) for v in row]) for row in got.fetchall())
        assert sorted(repr([plain(v) for v in row]) for row in df.select(*names).collect()) == want

    return check
