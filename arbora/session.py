"""Sessions: settings for jobs of this library, and getting it to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def build(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, times in UTC and Arrow."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once (a zip of a few hundred KB), so that Python workers find it."""
    sc = spark.sparkContext
    if getattr(sc, "_arbora_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="arbora-"), "arbora.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(HERE.rglob("*.py")):
            z.write(p, p.relative_to(HERE.parent))
    sc.addPyFile(path)
    sc._arbora_shipped = True
