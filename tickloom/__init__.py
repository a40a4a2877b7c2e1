"""Order-flow analytics over market-event tapes as PySpark DataFrame operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors of ``spark``, once per application.

    Not needed where the cluster has it installed. The archive is handed to
    Spark's file server, which serves executors that join later, too.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # the driver's own file; Spark copies it to wherever it serves files from
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tickloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("tickloom", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
