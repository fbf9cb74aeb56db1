"""Readers of the driver's tables, and views of them in the library's terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a catalogue: id, name, brand, path, price, size, kind. The path is the type, then the name's noun and its adjective."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.concat(F.array("p_type"), F.reverse(F.split("p_name", " "))).alias("path"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))


#: The same view for SQL.
PRODUCTS = "products AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, list_concat([p_type], list_reverse(string_split(p_name, ' '))) AS path, p_retailprice AS price, p_size AS size, p_type AS kind FROM part)"
#: Tokens in SQL, as functions.text.tokens.
TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
