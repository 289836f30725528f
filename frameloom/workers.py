"""Python workers must find this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Put the folder that holds this package on the workers' path, for sessions started without it.

    On a cluster install the package or pass it with --py-files; the entry is harmless there.
    """
    env = spark.sparkContext.environment
    here = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, here])
