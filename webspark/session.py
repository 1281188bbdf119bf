"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On clusters whose nodes do not share that path, submit the package with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)
