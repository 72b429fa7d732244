"""What a Spark session needs so that Python workers can import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> SparkSession:
    """In local mode, put this package on the workers' path if it isn't there. A cluster gets it as any package."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local":
        paths = [p for x in (os.environ.get("PYTHONPATH"), sc.environment.get("PYTHONPATH")) for p in (x or "").split(os.pathsep) if p]
        if ROOT not in map(os.path.abspath, paths):
            sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
