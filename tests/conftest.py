import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


from lectern.session import local_session

# Columns need a session, and test modules build some when they are imported.
SPARK = local_session("tests", 4, spark__ui__showConsoleProgress="false",
                      spark__checkpoint__dir=tempfile.mkdtemp(prefix="tests-"))


@pytest.fixture(scope="session")
def spark():
    return SPARK


@pytest.fixture
def evaluate(spark):
    """The value of a column over one row of strings."""

    def run(column, **values):
        schema = ", ".join(f"{k} STRING" for k in values) or "x STRING"
        row = tuple(values.values()) or ("",)
        return spark.createDataFrame([row], schema).select(column.alias("out")).first()["out"]

    return run
