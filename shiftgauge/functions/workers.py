"""Python workers of the tasks."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Where this package lies; tasks import it from there when nothing else installs it for them.
HOME = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Put HOME on the path of the tasks' Python, which need not start in the folder of the driver."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, paths)])
