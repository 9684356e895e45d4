"""Written intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one of our own only where it is unset and all runs here."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quern-")
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def file_states(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of change of a table's files: what tells whether it is still the table it was."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))


#: Ends the shuffle files of a statement with it.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables that cut lineage: a lost executor re-reads files instead of re-running the plan.

    Tables are named by a random run id, so reruns and concurrent jobs never meet. ``drop`` frees a table
    that no later plan reads; the rest goes with ``release``, or when the driver process ends.
    """

    _open: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quern-{label}-{uuid.uuid4().hex}"
        self._n = 0
        Scratch._open.append(self)

    def path(self) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}"

    def table(self, df: DataFrame, file_rows: int = 0) -> DataFrame:
        """Writes df and reads it back. What its plan has shuffled is freed once the table stands, as no later plan reads it.
        file_rows: rows of a file at most, where rows are large."""
        path, before = self.path(), self.spark.conf.get(CLEANED)
        self.spark.conf.set(CLEANED, "true")
        try:
            df.write.option("maxRecordsPerFile", file_rows).parquet(path)
        finally:
            self.spark.conf.set(CLEANED, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._quern_path = path
        return table

    def drop(self, table: DataFrame) -> None:
        delete(self.spark, table._quern_path)

    def _close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the session has ended first; its files are the cluster's to expire
            pass


@atexit.register
def release() -> None:
    """Frees the tables of all operators so far. Results that were not written or collected can't be read any more."""
    while Scratch._open:
        Scratch._open.pop()._close()
