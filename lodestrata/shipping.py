"""Let executors import this package where nothing else provides it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session's files, once, unless workers find it by their path or folder."""
    context = spark.sparkContext
    # Workers inherit the path; the driver's folder is theirs only where they run beside it.
    here = [os.getcwd()] if context.master.startswith("local") and "cluster" not in context.master else []
    found = {os.path.abspath(p) for p in (*here, *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}
    if context.applicationId in _shipped or str(_PACKAGE.parent) in found:
        return
    archive = Path(tempfile.mkdtemp(prefix="lodestrata-")) / "lodestrata.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(_PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(_PACKAGE.parent))
    # The driver serves the archive to every executor, also to those that join later.
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
