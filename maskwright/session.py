"""Sessions, and the package's code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for functions that run in Python there."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="maskwright-"), f"maskwright-{application}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared folder: the cluster's ``spark.checkpoint.dir``, else (tests, a single machine) our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir", "") or f"/tmp/checkpoints/maskwright-{context.applicationId}")
    return f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of ours that nothing reads any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of each job go when it ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, True)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def session(name: str = "maskwright", master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    builder = SparkSession.builder.appName(name).master(master)
    settings = {"spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "8g"}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
