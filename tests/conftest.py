import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoints-"))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    def build(rows):
        """rows: (project, path, content)"""
        return spark.createDataFrame(rows, "project_id string, path string, content string")

    return build


@pytest.fixture
def manifest(spark):
    import json

    from shiftgauge.sources.corpus import parsed_manifests

    def build(require=None, dev=None, project="p"):
        content = json.dumps({"require": require or {}, "require-dev": dev or {}})
        return parsed_manifests(spark.createDataFrame([(project, content)], "project_id string, content string"))

    return build


@pytest.fixture
def paths(spark):
    def build(*names, project="p"):
        return spark.createDataFrame([(project, n) for n in names], "project_id string, path string")

    return build
