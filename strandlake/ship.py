"""Make this package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers once per application, unless PYTHONPATH already has its folder."""
    app = spark.sparkContext.applicationId
    if app in _SENT or str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    path = Path(tempfile.mkdtemp(prefix="strandlake-ship-")) / "strandlake_src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted([*ROOT.rglob("*.py"), *ROOT.parent.glob("corpus_pipeline.py")]):
            z.write(f, f.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(path))
    _SENT.add(app)
