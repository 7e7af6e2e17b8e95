"""Make the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand the package to all executors, once per application.

    Spark itself distributes the archive, as with --py-files, so nothing has to be installed
    on the workers and module state lives as long as a worker.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="rastertables-"), "rastertables_package.zip")
    with zipfile.ZipFile(archive, "w") as target:
        for folder, _, files in os.walk(package):
            for name in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, name)
                target.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
