import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from driftloom.session import local_session

    session = local_session(8, "driftloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def instances_of(spark):
    """Instances table from a list of (tokens, label, t)."""
    from pyspark.sql import functions as F

    from driftloom.functions.text import token_bag
    from driftloom.session import cut

    def build(rows, stream="s"):
        df = spark.createDataFrame(
            [(stream, 0, i, float(t), int(y), list(words)) for i, (words, y, t) in enumerate(rows)],
            "stream string, seed int, idx long, t double, label int, tokens array<string>")
        return cut(df.select("stream", "seed", "idx", "t", "label", token_bag(F.col("tokens")).alias("bag")), "test")

    return build
