"""Sends this package to the executors, so that their Python finds it wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a context; Spark's own file service carries the archive, so no folder need be shared."""
    sc = spark.sparkContext
    if getattr(sc, "_marlstone_sent", False):
        return
    top, folder = Path(__file__).resolve().parents[1], tempfile.mkdtemp(prefix="marlstone-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/marlstone.zip", "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(f"{folder}/marlstone.zip")
    sc._marlstone_sent = True
