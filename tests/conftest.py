import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from secretsift.session import local_session  # noqa: E402



@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "secretsift-tests", spark__ui__showConsoleProgress="false")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mini_rules(spark):
    """A small suffix list with every kind of rule."""
    from secretsift.sources.suffixes import prepare_rules

    public = ["com", "org", "net", "uk", "co.uk", "io", "*.ck", "!www.ck"]
    rows = [(r, False) for r in public] + [("github.io", True)]
    return prepare_rules(spark.createDataFrame(rows, "rule string, private boolean"))


@pytest.fixture(scope="session")
def apply(spark):
    """Apply a column function to texts and return the results in order."""
    from pyspark.sql import functions as F

    def run(function, values):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        out = rows.select("i", function(F.col("v")).alias("r")).collect()
        return [r for _, r in sorted((row.i, row.r) for row in out)] if values else []

    return run
