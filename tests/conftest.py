import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    """Rows of a pandas frame, by column name, as sorted tuples of plain values."""
    frame = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    return sorted((tuple(r) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="session")
def same(spark, duck, data):
    """Holds a registered query against its SQL."""

    def check(query, sql):
        got, want = query(spark, data).toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got), rows(want)
        assert len(a) == len(b)
        assert [str(x) for x in a] == [str(x) for x in b]

    return check
