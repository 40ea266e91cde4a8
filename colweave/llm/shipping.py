"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import colweave

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hand the package to Spark, which serves it to the workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(colweave.__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="colweave-"), "colweave")
        context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(package), "colweave"))
        _SHIPPED.add(context.applicationId)
    return spark
