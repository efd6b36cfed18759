"""What a session needs once: this package's source on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once a SparkContext, so that they need no path to it."""
    if getattr(ship, "sent", None) != spark.sparkContext.applicationId:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        ship.sent = spark.sparkContext.applicationId
