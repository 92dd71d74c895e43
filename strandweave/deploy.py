"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources to the session, unless the workers' path has them; the driver serves the archive."""
    sc = spark.sparkContext
    on_path = str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(":")
    if on_path or getattr(sc, "_strandweave_shipped", False):
        return spark
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/strandweave_sources.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_ROOT.rglob("*.py")):
            out.write(path, path.relative_to(_ROOT.parent))
    sc.addPyFile(archive)
    sc._strandweave_shipped = True
    return spark
