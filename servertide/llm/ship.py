"""Python workers get this package with the job, so that it need not be installed on the executors.

They also get whole texts, so batches are bounded in bytes and not only in rows.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import servertide

_sent: set[str] = set()


#: Bytes and rows of the batches that workers get.
BATCH_BYTES, BATCH_ROWS = "4m", "2000"


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of ``spark``'s application, once, and bound the session's batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(servertide.__file__))
    # Spark copies the archive to all executors; only the driver reads this folder.
    archive = os.path.join(tempfile.mkdtemp(prefix="servertide-code-"), "servertide.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.join("servertide", os.path.relpath(path, root)))
    context.addPyFile(archive)
    _sent.add(context.applicationId)
