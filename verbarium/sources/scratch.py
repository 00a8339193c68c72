"""Tables between jobs, in the folder that a cluster shares, and this package on its way to the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is a single local JVM (tests) a
    temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="verbarium-")
    return _own_dirs[sc.applicationId]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that Python workers find it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    name = os.path.join(tempfile.mkdtemp(prefix="verbarium-"), "verbarium.zip")
    with zipfile.ZipFile(name, "w") as out:
        for folder, _, files in os.walk(os.path.join(top, "verbarium")):
            for f in files:
                if f.endswith(".py"):
                    out.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), top))
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)


class Scratch:
    """Tables in the shared folder that cut lineage; they go when the driver's JVM ends, or by drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship(spark)
        self.root = f"{shared_dir(spark)}/verbarium/{name}-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(self.root))
        self.fs.deleteOnExit(self._path(self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return a DataFrame that reads it."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads; all of them, if none is named."""
        for path in [self.path(n) for n in names] or [self.root]:
            self.fs.delete(self._path(path), True)
