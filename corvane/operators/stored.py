"""Working tables in the cluster's shared folder: they cut lineage, outlive executors, and go when the driver's program ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Tables:
    """A new folder of tables; ``drop`` deletes what nothing will read again."""

    made: list[tuple] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made.append(self._at(""))

    def _at(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        path, system = self._at(name)
        system.delete(path, True)


@atexit.register
def cleared() -> None:
    """Delete the tables of this program; where the JVM is gone already, they stay."""
    while Tables.made:
        path, system = Tables.made.pop()
        try:
            system.delete(path, True)
        except Exception:  # noqa: BLE001 the gateway may be closed
            return
