import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dosescreen.session import build_session, drop_stages  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_stages(session)
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a one-column expression on literal inputs."""
    def run(inputs, kind, expression):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}").coalesce(1)
        return [r[1] for r in sorted(df.select("i", expression("x")).collect())]

    return run


def rows(df, *columns):
    df = df.select(*[f"`{c}`" for c in columns]) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=repr)
