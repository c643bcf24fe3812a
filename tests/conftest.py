import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tenure.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a small DataFrame from tuples; timestamps are given as text."""

    def build(schema, data):
        names = [part.split()[0] for part in schema.split(",")]
        types = dict(part.split() for part in (p.strip() for p in schema.split(",")))
        raw = ", ".join(f"{n} {'string' if types[n] in ('timestamp_ntz', 'date') else types[n]}" for n in types)
        df = spark.createDataFrame(data, raw)
        return df.select(*[df[n.strip()].cast(types[n.strip()]) for n in names])

    return build
