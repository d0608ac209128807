import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(frame):
    """Rows of a pandas frame as sorted tuples of text, columns by name, floats to nine digits."""
    import pandas as pd

    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        cells = []
        for v in row:
            if hasattr(v, "tolist"):
                v = v.tolist()
            if v is pd.NA:
                v = None
            if isinstance(v, float):
                v = None if v != v else int(v) if v.is_integer() else round(v, 9)
            cells.append(repr(v))
        out.append(tuple(cells))
    return sorted(out)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql):
        ours, theirs = query(spark, SF).toPandas(), duck.execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert norm(ours) == norm(theirs)

    return check
