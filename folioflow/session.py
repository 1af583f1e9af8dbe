"""Makes the package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Local masters read the package where it lies; other clusters get it as a zip from the driver, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if sc.master.startswith("local"):
        held = sc.environment.get("PYTHONPATH")
        sc.environment["PYTHONPATH"] = f"{ROOT}:{held}" if held else str(ROOT)
    else:
        sc.addPyFile(shutil.make_archive(str(Path(tempfile.mkdtemp()) / "folioflow"), "zip", ROOT, "folioflow"))
