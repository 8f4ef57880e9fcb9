import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df):
    """Rows as dicts, in an order that their values decide."""
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=repr)


def same_as_sql(spark, sf_dir, query, sql):
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, wanted = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    names = sorted(got.columns)
    assert names == sorted(wanted.columns)

    def values(frame):
        frame = frame[names].astype(object)
        return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.where(frame.notna(), None).values.tolist())

    assert values(got) == values(wanted)
