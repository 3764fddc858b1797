"""What a query needs of its session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, and bound the bytes of an Arrow batch: many short rows go together, few long ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(), f"{home.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"{home.name}/{f.relative_to(home)}")
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
