"""The corpus pipeline: language ID, near-dedup, decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the last
return the columns of documents. Rows leave only in the first three: texts that language ID rejects,
all but one of a near-duplicate group, texts that hold a benchmark item. Secret scans blank the spans
they find and keep the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, langid, neardup, packing, queries, secrets
from corvane.llm.common import Workspace, free


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier rejects go. The labels it learns from are those of the documents."""
    model = langid.fit(docs, F.lit(True))
    names = free(docs.columns, *langid.NAMES)
    return langid.identify(docs, model, names=names).where(~F.col(names[2])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the first of the smallest id: five words, similarity 0.8.

    Rows are told apart by stored numbers, so null and repeated ids change nothing; rows without words all stay.
    """
    (number,) = free(docs.columns, "_row")
    numbered = Workspace(spark, "numbered").save(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    groups = neardup.group(numbered, shingle=5, threshold=(80, 100), row_col=number)
    gone = groups.where(~F.col("kept")).select(F.col("row").alias(number))
    return numbered.join(gone, number, "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, each by its own text."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans are blanked; n_chars follows the text."""
    clean = secrets.redact(docs, *secrets.ledgered(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.VOCABULARY, queries.RANKS)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("packing", packed),
]

#: No stage but the fourth can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = space.save(stage(spark, docs, sf_dir), name)
        if before:
            space.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
