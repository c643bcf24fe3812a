import pytest


@pytest.fixture
def frame(spark):
    """DataFrame from a DDL schema and tuples."""

    def build(schema, rows):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture
def long_text():
    """A text much longer than any usual one."""
    return " ".join(f"word{i % 977}" for i in range(60_000))


@pytest.fixture
def table_dir(tmp_path, spark):
    """Folder with the given tables as Parquet."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
