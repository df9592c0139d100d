import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loglens.session import get_session

    s = get_session("local[4]", shuffle_partitions=4, app="loglens-tests")
    yield s


def lines_df(spark, files: dict[str, list[str]], mtime: str = "2024-01-01 00:00:00"):
    """A lines table from {path: [line, ...]}."""
    from pyspark.sql import functions as F

    rows = [(p, i, l) for p, ls in files.items() for i, l in enumerate(ls)]
    df = spark.createDataFrame(rows, "path string, line_no long, line string")
    return df.withColumn("file_mtime", F.lit(mtime).cast("timestamp"))
