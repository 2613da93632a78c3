"""Sends this package to the executors, so that Python workers can import it wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; Spark hands the archive to executors that come later, too."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if context.applicationId in _DONE or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="orrery-")) / "orrery.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(archive))
    _DONE.add(context.applicationId)
