"""Send the package to the executors of a session that was started without it on its path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's own sources as a zip, once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    folder = Path(tempfile.mkdtemp(prefix="sparkdom-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(folder / "sparkdom.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("sparkdom") / p.relative_to(root))
    context.addPyFile(str(folder / "sparkdom.zip"))
    _done.add(context.applicationId)
