"""A training corpus from documents: toxic ones out, near copies to one, personal data replaced, packed.

STAGES lists (name, function).  Each function takes (spark, docs, sf_dir) and returns a DataFrame;
all but the last return the columns of documents.  Between stages the documents are written and read
again, so that each stage's input is a table and a lost executor costs no more than one stage.

Defined cases: documents with null or empty texts pass every stage (they are not toxic, copies of
nothing, and pack as their end id); rows with a null id are kept; of repeated rows with one id and text
one is kept, while different texts of one id are documents of their own; columns of any name beside those
of documents are kept up to the packing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table, written
from lodestone.llm.overlap import ngram_jaccard
from lodestone.llm.packing import pack_documents
from lodestone.llm.pii import redact
from lodestone.llm.toxicity import THRESHOLD, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers, trained on these documents and the labels, don't reject."""
    name = "score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    rated = toxicity(docs, table(spark, sf_dir, "labels"), name=name)
    return rated.where(F.col(name) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id.

    Documents are told apart by a hash of id and text.  Of repeated rows one is left by each task before
    any row moves, so that an id or a text which a third of all rows share is not one task's.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").alias("id"), F.col("text").alias("text"), F.struct(*columns).alias("row"))
    known = keyed.where("id IS NOT NULL")
    found = ngram_jaccard(known, key="key").select("key", F.col("component_id").alias("class")).distinct()
    least = known.select("key", "id").distinct().join(found, "key").groupBy("class").agg(F.min(F.struct("id", "key")).alias("least"))
    one = known.groupBy("key").agg(F.first("row").alias("row"))
    kept = one.join(least.select(F.col("least.key").alias("key")), "key", "left_semi")
    return kept.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the spans of personal data replaced by their kinds."""
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents, with their ids (as bytes, four for each id, the lowest first) and
    places in sequences of a fixed length."""
    return pack_documents(docs, with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", without_copies),
    ("pii", without_personal_data),
    ("best_fit_packing", packed),
]

#: Training and packing are not SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict = {}
