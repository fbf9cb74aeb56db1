"""Readers and writers with the checks that records, questions and snapshots need."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class InvalidSource(ValueError):
    """A source that lacks columns or keys, or doesn't match its manifest."""


def require(df: DataFrame, columns: list[str], where: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InvalidSource(f"{where} lacks {', '.join(missing)}")
    return df


def json_records(spark: SparkSession, path: str, required: list[str], order: str, limit: int | None = None) -> DataFrame:
    """A JSON array with row_id from 0 in ``order``; a record without a required field is an error."""
    df = require(spark.read.option("multiLine", True).json(path), required, path)
    if order not in required and order not in df.columns:
        raise InvalidSource(f"{path} lacks {order}")
    bad = df.where(" or ".join(f"`{c}` is null" for c in required)).limit(1).count()
    if bad:
        raise InvalidSource(f"{path} has a record without {', '.join(required)}")
    return df.orderBy(order).limit(limit) if limit else df


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def csv_table(spark: SparkSession, path: str, required: list[str], key: str) -> DataFrame:
    """CSV with a header; a byte-order mark before the first name goes, and so do rows with a blank key."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return require(df, required, path).where(F.col(key).isNotNull() & (F.trim(key) != ""))


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, page (from 1), text of whole files cut at form feeds."""
    whole = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\f")).alias("_n", "text")).select("path", (F.col("_n") + 1).alias("page"), "text")


def bundle(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per object of a {"objects": [...]} bundle."""
    return spark.read.schema(f"type string, objects array<struct<{schema}>>").option("multiLine", True).json(path).selectExpr("inline(objects)")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_snapshot(df: DataFrame, path: str, version: int, manifest: dict) -> None:
    """A complete version beside the earlier ones: rows first, then its manifest by rename."""
    spark = df.sparkSession
    target = f"{path}/v={version}"
    df.write.mode("error").parquet(f"{target}/rows")
    count = spark.read.parquet(f"{target}/rows").count()
    text = json.dumps({**manifest, "version": version, "rows": count}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{target}/_manifest.tmp")
    fs, source = _file(spark, f"{target}/_manifest.tmp")
    fs.rename(source, _file(spark, f"{target}/manifest")[1])


def read_snapshot(spark: SparkSession, path: str, **expected: object) -> tuple[DataFrame, dict]:
    """Rows and manifest of the newest version that is complete and as expected; older ones stand in for bad ones."""
    fs, root = _file(spark, path)
    if not fs.exists(root):
        raise InvalidSource(f"no snapshot in {path}")
    versions = sorted((int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if s.getPath().getName()[:2] == "v="), reverse=True)
    for version in versions:
        fs_m, where = _file(spark, f"{path}/v={version}/manifest")
        if not fs_m.exists(where):
            continue
        manifest = json.loads(spark.read.text(f"{path}/v={version}/manifest").first()[0])
        rows = spark.read.parquet(f"{path}/v={version}/rows")
        if all(manifest.get(k) == v for k, v in expected.items()) and rows.count() == manifest["rows"]:
            return rows, manifest
    raise InvalidSource(f"no valid snapshot in {path}")


def needs_rebuild(spark: SparkSession, path: str, fingerprint: str) -> bool:
    """Whether the newest valid snapshot has another fingerprint, or there is none."""
    try:
        return read_snapshot(spark, path)[1].get("fingerprint") != fingerprint
    except InvalidSource:
        return True


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True, escape='"')


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """value: GraphML elements, one per row, nodes first by ``part``."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.lit(0).alias("part"), F.format_string('<node id="%s"><data key="label">%s</data></node>', esc("id"), esc("label")).alias("value"))
    e = edges.select(F.lit(1).alias("part"), F.format_string('<edge source="%s" target="%s"><data key="type">%s</data></edge>', esc("source"), esc("target"), esc("type")).alias("value"))
    return n.unionByName(e)
