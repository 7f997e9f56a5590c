import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

import pandas as pd  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return con


def canonical(pdf):
    """Rows of a frame as sorted tuples of strings, for comparing engines."""

    def text(x):
        if pd.isna(x):
            return "null"
        if isinstance(x, float) and x == int(x) and abs(x) < 1e15:
            return str(int(x))
        return f"{x:.9f}" if isinstance(x, float) else str(x)

    cols = sorted(pdf.columns)
    return sorted(tuple(text(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None))
