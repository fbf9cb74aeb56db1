"""Shared helpers: working tables in the cluster's shared folder, byte-level words, stable folds."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that a Python operator returns at once.
OUT_ROWS = 20_000

#: Texts of a batch that are copied at once.
TEXTS = 500

#: By operator, what empties the caches that a Python worker keeps between tasks.
CACHES: dict[str, Callable[[], None]] = {}

#: The white space that separates words, as code points.
WORD_BREAKS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """Tables written in the shared folder; they cut lineage and outlive executors, and go when the driver's program ends.

    Results are lazy and read them until then; ``drop`` deletes earlier what nothing reads again.
    """

    made: list[tuple] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.made.append((path, path.getFileSystem(spark._jsc.hadoopConfiguration())))

    def save(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write ``df`` once and read it again."""
        writer = df.write.mode("overwrite")
        (writer.option("compression", compression) if compression else writer).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that nothing will read again."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def cleared() -> None:
    """Delete all workspaces of this program; where the JVM is gone already, they stay."""
    while Workspace.made:
        path, system = Workspace.made.pop()
        try:
            system.delete(path, True)
        except Exception:  # noqa: BLE001 the gateway may be closed
            return


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def serving(operator: str) -> None:
    """A worker serves one operator after another: as a task of one begins, the caches of the others are emptied."""
    for name, clear in CACHES.items():
        if name != operator:
            clear()


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of a string column, TEXTS rows at a time; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    for at in range(0, len(column), TEXTS):
        yield from (x or b"" for x in column.slice(at, TEXTS).to_pylist())


def words(text: bytes) -> list[bytes]:
    """A-Z in lower case, split at the bytes 0x20 and 0x09 to 0x0D: what bytes.lower and bytes.split do."""
    return text.lower().split()


def emitted(rows: Iterator[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` of the rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield as_batch(held, schema)
            held = []
    if held:
        yield as_batch(held, schema)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def free(taken: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column of ``taken`` has it."""
    lower = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in lower:
            name += "_"
        out.append(name)
    return out


def sampled(rows: DataFrame, most: int, label: str | None = None) -> list[tuple]:
    """(_id, label) of at most ``most`` distinct ids of each label, those of the smallest hashes.

    The labels' rows are counted; a bound on the hash leaves about twice as many ids as wanted, and only these reach the driver.
    """
    spark = rows.sparkSession
    wide = 1 << 40
    rows = rows.select("_id", (F.col(label) if label else F.lit("")).alias("_label")).where("_id is not null")
    counts = rows.groupBy("_label").agg(F.count("*").alias("n")).collect()  # one row of each label
    if not counts:
        return []
    bounds = spark.createDataFrame([(r["_label"], min(wide, -(-wide * (2 * most + 50) // r["n"]))) for r in counts], f"_name {rows.schema['_label'].dataType.simpleString()}, _bound long")
    hashed = rows.withColumn("_hash", F.pmod(F.xxhash64("_id"), F.lit(wide)))
    near = hashed.join(F.broadcast(bounds), F.col("_label").eqNullSafe(F.col("_name"))).where("_hash < _bound").select("_id", "_label", "_hash").distinct().collect()
    taken: dict = {}
    for r in sorted(near, key=lambda r: (r["_hash"], r["_id"])):
        own = taken.setdefault(r["_label"], [])
        if len(own) < most:
            own.append(r["_id"])
    return [(i, name) for name, own in taken.items() for i in own]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
