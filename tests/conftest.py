import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def same_rows(df, expected) -> None:
    """Both frames hold the same rows, whatever their order."""

    def rows(frame):
        return sorted(tuple("" if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in frame.itertuples(index=False))

    a = df.toPandas()
    assert sorted(a.columns) == sorted(expected.columns)
    cols = sorted(a.columns)
    x, y = rows(a[cols].astype(object).where(a[cols].notna(), None)), rows(expected[cols].astype(object).where(expected[cols].notna(), None))
    assert len(x) == len(y)
    for p, q in zip(sorted(map(str, x)), sorted(map(str, y)), strict=True):
        assert p == q
