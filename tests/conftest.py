import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


def _plain(v):
    if v is None:
        return None
    if hasattr(v, "is_nan") or type(v).__name__ == "Decimal":
        v = float(v)
    return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v


@pytest.fixture(scope="session")
def same():
    """Whether a frame and an SQL result hold the same rows under the same names."""

    def check(df, relation):
        names = sorted(df.columns)
        assert names == sorted(relation.columns)
        left = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
        at = [relation.columns.index(c) for c in names]
        right = [tuple(_plain(r[i]) for i in at) for r in relation.fetchall()]
        order = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(left, key=order) == sorted(right, key=order)

    return check
