"""Tables that a stream keeps, a version for each of its batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Versions of some tables below a folder that the whole cluster shares.

    A version is written under its batch's number and counts once its marker
    is there, which is created last. A batch that runs again, as streams do
    after a failure, finds its own version complete and adds nothing, or
    incomplete and writes it anew from the version before. Of the versions
    before the last one only ``keep`` stay.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def complete(self) -> list[int]:
        """Numbers of the complete versions, in order."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.folder}/{n}/_COMPLETE")))

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of this version, or of the last complete one; None without any."""
        done = self.complete()
        version = version if version is not None else done[-1] if done else None
        return None if version is None else self.spark.read.parquet(f"{self.folder}/{version}/{name}")

    def write(self, version: int, **tables: DataFrame) -> bool:
        """Add a version; False if it is there already."""
        done = self.complete()
        if done and version <= done[-1]:
            return False
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{version}/{name}")
        self._fs.create(self._path(f"{self.folder}/{version}/_COMPLETE"), True).close()
        for old in self.complete()[: -self.keep - 1]:
            self._fs.delete(self._path(f"{self.folder}/{old}"), True)
        return True
