"""Taking the package along to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to all Python workers, once for each application.

    Executors import it from there wherever the driver runs and whatever their own folders hold.  A package that was
    itself loaded from an archive is there already.
    """
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    _SHIPPED.add(sc.applicationId)
    out = Path(tempfile.mkdtemp(prefix="wordloom-")) / "wordloom_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(out))
