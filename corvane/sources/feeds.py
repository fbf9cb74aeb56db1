"""A table of feeds, each replaced whole: rows are written first, then one entry of a log names them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .files import InvalidSource


class Conflict(RuntimeError):
    """Another writer has replaced the feed since this one looked."""


class Feeds:
    """Feeds under ``path``: ``rows/<id>`` holds the rows of one write, ``log/<version>`` which write each feed has.

    A version is a file that is renamed into place, and only if no other has its name; so readers see all of a feed's old rows or all of its
    new ones, and of two writers of one feed one wins. Rows of a writer that was killed are named by no version and are read by nobody.
    The file system must rename without overwriting, as HDFS does. The driver holds one name per feed, never rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 where nothing has been written."""
        path, system = self._at("log")
        names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def entry(self, version: int) -> dict:
        """feeds: the write that each feed has at a version; schema."""
        if version == 0:
            return {"feeds": {}, "schema": None}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/log/{version:012d}").first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of all feeds at a version, the newest if none is given."""
        entry = self.entry(self.version() if version is None else version)
        if entry["schema"] is None:
            raise InvalidSource(f"no feed in {self.path}")
        schema = StructType.fromJson(json.loads(entry["schema"]))
        folders = [f"{self.path}/rows/{w}" for w in sorted(entry["feeds"].values())]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def replace(self, feed: str, rows: DataFrame | None, seen: int | None = None) -> int:
        """The version in which a feed holds these rows and no others; without rows the feed is gone.

        ``seen`` is the version the writer worked from, the newest one if not given. A feed that another has replaced since is a Conflict and
        stays as it is; changes of other feeds are taken over.
        """
        seen = self.version() if seen is None else seen
        before = self.entry(seen)
        write = None
        if rows is not None:
            if before["schema"] is not None and StructType.fromJson(json.loads(before["schema"])).simpleString() != rows.schema.simpleString():
                raise InvalidSource(f"{feed} has other columns than {self.path}")
            write = uuid.uuid4().hex
            rows.write.parquet(f"{self.path}/rows/{write}")
        while True:
            head = self.version()
            entry = self.entry(head)
            if entry["feeds"].get(feed) != before["feeds"].get(feed):
                self._delete(write)
                raise Conflict(f"{feed} was replaced after version {seen}")
            named = {**entry["feeds"], feed: write}
            if write is None:
                del named[feed]
            schema = entry["schema"] or (rows.schema.json() if rows is not None else None)
            if self._claim(head + 1, json.dumps({"feeds": named, "schema": schema})):
                return head + 1

    def _delete(self, write: str | None) -> None:
        if write:
            path, system = self._at(f"rows/{write}")
            system.delete(path, True)

    def _claim(self, version: int, text: str) -> bool:
        """Write a version's file beside the log and rename it into place; False if the version is there already."""
        jvm = self.spark._jvm
        fresh, system = self._at(f"fresh/{uuid.uuid4().hex}")
        target, _ = self._at(f"log/{version:012d}")
        out = system.create(fresh, False)
        out.write(text.encode())
        out.close()
        system.mkdirs(target.getParent())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, target, options)
        except Exception:
            if not system.exists(target):
                raise
            system.delete(fresh, False)
            return False
        return True
