import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def grid(spark):
    """A grid from nested lists: ``None`` is NoData, ``"."`` no cell."""

    def make(rows, name="v"):
        cells = [
            (r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row) if v != "."
        ]
        return spark.createDataFrame(cells, f"r long, c long, {name} int")

    return make


@pytest.fixture
def region(spark):
    """Cells of features from text: letters name features, dots are empty."""

    def make(*rows):
        cells = [
            (ord(x) - ord("a"), r, c) for r, row in enumerate(rows) for c, x in enumerate(row) if x != "."
        ]
        return spark.createDataFrame(cells, "feat_id long, r long, c long")

    return make
