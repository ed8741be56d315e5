import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def compare():
    """Compares a Spark result with SQL over the tables of a folder, without order."""
    import duckdb

    def rows(columns, data):
        order = sorted(range(len(columns)), key=columns.__getitem__)
        return sorted(str([round(float(r[k]), 5) if isinstance(r[k], float) else r[k] for k in order]) for r in data)

    def check(df, sql, folder):
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from '{p}'")
        rel = con.sql(sql)
        want = rel.fetchall()
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, want)

    return check
