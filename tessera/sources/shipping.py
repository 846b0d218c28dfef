"""Python workers need this package; Spark sends it to them with the application."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the files of the application, once; the driver serves it to executors that come later too."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera-package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
    context._tessera_shipped = True
