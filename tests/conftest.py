import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from vantage.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "6g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply a column function to a list of argument tuples: evaluate(fn, rows, ddl)."""
    def run(fn, rows, ddl):
        names = [part.strip().split(" ")[0] for part in ddl.split(",")]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {ddl}")
        from pyspark.sql import functions as F

        out = df.select("_i", fn(*[F.col(n) for n in names]).alias("out")).orderBy("_i")
        return [r["out"] for r in out.collect()]

    return run
