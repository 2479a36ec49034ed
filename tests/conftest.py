import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(mine, theirs) -> None:
    """Equal columns and rows, in any order."""
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)

    def rows(d):
        text = d[columns].astype(str).replace({"<NA>": "nan", "None": "nan", "NaT": "nan"})
        return sorted("|".join(x[:-2] if x.endswith(".0") else x for x in r) for r in text.to_numpy().tolist())

    assert rows(mine) == rows(theirs)
