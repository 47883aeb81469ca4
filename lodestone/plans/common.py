"""Views of the tables that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is the repository, the id the path."""
    docs = spread(table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "text"))
    return docs.select(F.col("source").alias("repository"), F.col("doc_id").cast("string").alias("path"), "lang", F.col("text").alias("content"))


#: The same in SQL, and its lines.
CORPUS = "corpus AS (SELECT source AS repository, CAST(doc_id AS VARCHAR) AS path, lang, text AS content FROM documents)"
LINES = r"""lines AS (
  SELECT repository, path, lang, i AS line_no, l[i] AS line
  FROM (SELECT repository, path, lang, string_split_regex(content, '\r?\n') AS l FROM corpus), unnest(range(1, len(l) + 1)) AS t(i))"""
