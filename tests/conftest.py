import os
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
    local = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.local.dir", local).config("spark.checkpoint.dir", f"file://{local}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{local}/warehouse").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows_of(frame):
    """Rows of a pandas table as comparable tuples, columns and rows sorted."""
    def plain(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or isinstance(x, float) and x != x:
            return "NULL"
        return repr(round(x, 9)) if isinstance(x, float) else repr(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))


def same_as_sql(spark, name, sf=SF):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf).toPandas(), con.sql(entry.oracle_sql()[name]).to_arrow_table().to_pandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
