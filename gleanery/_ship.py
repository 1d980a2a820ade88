"""Send this package to Python workers that can't import it by themselves."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="gleanery-package-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "gleanery_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path("gleanery") / path.relative_to(root))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
