"""Tables written under the shared folder: they cut lineage, survive lost executors and have a known size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

FILE_VALUES = 500_000
# Without its native library Hadoop's local file system starts a process for each mode that it sets, on checksum files too.
LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one in the warehouse is set for this session."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shelf"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Shelf:
    """Tables written under the shared folder, in order to cut lineage or to be read more than once.

    Tables that a returned DataFrame still reads stay there until the driver ends, or the block of
    ``released`` does in which the shelf was made; drop() removes the others at once.
    """

    made: list[Shelf] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.kept = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", False
        self.held: dict[str, DataFrame] = {}
        Shelf.made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, values: int | None = None) -> DataFrame:
        """``values``: about as many numbers are in the table, so it is written in files of FILE_VALUES
        (at least one a core) instead of one for each shuffle partition. It bounds no rows."""
        if values is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-values // FILE_VALUES)))
        df.write.options(**LOCAL).parquet(self.path(name))
        if not self.kept:
            files, path = self._at(self.root)
            self.kept = files.deleteOnExit(path)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def hold(self, df: DataFrame, name: str) -> DataFrame:
        """For tables of few numbers a row that the same job reads again: kept by the executors on their disks, and made
        again where one is lost. It writes no files of its own, so no process is started for them."""
        self.held[name] = df.persist(StorageLevel.DISK_ONLY)
        return self.held[name]

    def _at(self, path: str) -> tuple:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.held:
                self.held.pop(name).unpersist()
                continue
            files, path = self._at(self.path(name))
            files.delete(path, True)

    def drop_all(self) -> None:
        self.drop(*list(self.held))
        files, path = self._at(self.root)
        files.delete(path, True)


@contextmanager
def released() -> Iterator[None]:
    """Shelves made in the block go with its end: what was read from them has been written elsewhere."""
    before, Shelf.made = Shelf.made, []
    try:
        yield
    finally:
        for shelf in Shelf.made:
            shelf.drop_all()
        Shelf.made = before
