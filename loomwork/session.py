"""What a session needs to run the package's Python operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it.

    For local sessions and shared file systems; elsewhere install it or pass it by ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark
