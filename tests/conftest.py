import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(spark_df, relation):
    """Equal rows under equal column names, doubles to six digits."""
    names = sorted(spark_df.columns)
    assert names == sorted(relation.columns)

    def norm(v):
        return None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    def rows(found, columns):
        at = [columns.index(n) for n in names]
        return sorted((tuple(norm(r[k]) for k in at) for r in found), key=str)

    left = rows([tuple(r) for r in spark_df.collect()], spark_df.columns)
    right = rows(relation.fetchall(), relation.columns)
    assert left == right
