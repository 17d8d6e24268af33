from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(shared))
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its oracle on a size of the driver's tables and compares all values."""
    import duckdb

    def normal(frame):
        cell = lambda v: repr(list(v)) if hasattr(v, "__iter__") and not isinstance(v, str) else None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v
        frame = frame[sorted(frame.columns)].map(cell)
        return sorted(map(tuple, frame.astype(str).values.tolist()))

    def run(query, sql, sf="sf0.001"):
        db = duckdb.connect()
        for path in (DATA / sf).iterdir():
            name = path.name.split(".")[0]
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path if path.is_file() else f'{path}/*.parquet'}'")
        ours, theirs = query(spark, str(DATA / sf)).toPandas(), db.sql(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert normal(ours) == normal(theirs)

    return run
