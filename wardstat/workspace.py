"""What an analysis materialises, owned by a scope.

A ``Workspace`` keeps persisted frames and the tables it writes under the session's
checkpoint folder, and releases both when it is closed: at the end of its ``with``
block, also after a failure, through Spark's cache and the Hadoop file system.  A
driver that ends without closing leaves the folder to the file system's own
deletion at exit.

    with Workspace(spark) as work:
        stays = work.written(placed, "stays")      # lineage ends here
        rows = work.persisted(readmissions)        # recomputed if blocks are lost
        ...

Written tables survive the loss of executors (they are re-read); persisted ones are
recomputed from lineage.  Nothing is created before it is asked for.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from wardstat.session import ensure_checkpoint_dir


def _path(spark: SparkSession, name: str):
    """(Hadoop path, its file system)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the session's checkpoint folder, deleted when the driver
    ends if nobody did before."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path, fs = _path(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


class Workspace:
    """The persisted frames and the scratch folder of one analysis."""

    def __init__(self, spark: SparkSession, name: str = "wardstat"):
        self.spark, self.name = spark, name
        self._frames: list[DataFrame] = []
        self._folder: str | None = None
        self.closed = False

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("this workspace is closed")

    @property
    def folder(self) -> str:
        """The scratch folder, made when first asked for."""
        self._open()
        if self._folder is None:
            self._folder = scratch_folder(self.spark, self.name)
        return self._folder

    def persisted(self, df: DataFrame) -> DataFrame:
        """``df`` kept in memory and on disk until the workspace is closed."""
        self._open()
        self._frames.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self._frames[-1]

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as a Parquet table now and read back; its lineage ends there."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def kept(self, df: DataFrame, name: str, how: str) -> DataFrame:
        """``df`` as ``how`` says: ``persist``, ``checkpoint`` (written) or ``none``."""
        if how == "persist":
            return self.persisted(df)
        if how == "checkpoint":
            return self.written(df, name)
        if how == "none":
            return df
        raise ValueError(f"unknown materialize mode {how!r}")

    def close(self) -> None:
        """Release everything; closing twice does nothing."""
        self.closed = True
        while self._frames:
            self._frames.pop().unpersist()
        if self._folder is not None:
            path, fs = _path(self.spark, self._folder)
            fs.delete(path, True)
            self._folder = None
