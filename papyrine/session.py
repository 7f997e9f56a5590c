"""Session set-up that the queries share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so workers need no shared checkout."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    folder_ = tempfile.mkdtemp(prefix="papyrine-")
    atexit.register(shutil.rmtree, folder_, ignore_errors=True)
    out = os.path.join(folder_, "papyrine.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("papyrine", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(out)
