"""Queries on stored tables: a graph store over several commits, an index of signatures, a text index."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import clones
from lodestone.operators.lsh import LshIndex
from lodestone.operators.search import B, DIGITS, K1, TextIndex
from lodestone.operators.store import GraphStore
from lodestone.plans.cloning import _LSH
from lodestone.plans.common import table
from lodestone.tables import scratch, spread, written


def _none():
    return F.lit(None).cast("map<string,string>").alias("metadata")


def store_commits(spark, d):
    """Documents and their sources as nodes, over four commits: all are put, those labelled as toxic are put
    anew without edges, those labelled as neither good nor toxic are deleted; then the changes are folded."""
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "lang")).withColumn("id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    node = lambda df, label: df.select("id", F.col("source").alias("repository"), F.lit("file").alias("type"), label.alias("label"), F.col("doc_id").cast("string").alias("file_path"), _none())
    sources = docs.select("source").distinct().select(F.concat(F.lit("src:"), "source").alias("id"), F.col("source").alias("repository"), F.lit("class").alias("type"), F.col("source").alias("label"), F.lit("").alias("file_path"), _none())
    edges = docs.select(F.col("id").alias("src"), F.concat(F.lit("src:"), "source").alias("dst"), F.lit("defines").alias("type"), F.col("source").alias("repository"), _none())
    store = GraphStore(spark, scratch(spark))
    store.apply_delta(node(docs, F.col("lang")).unionByName(sources), edges)
    toxic = written(docs.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi"))
    files = toxic.select(F.col("doc_id").cast("string").alias("file_path"), F.col("source").alias("repository"), F.sha2("id", 256).alias("file_hash"), F.lit(1).cast("long").alias("node_count"), F.lit(None).cast("timestamp").alias("indexed_at"))
    store.replace_files(files, node(toxic, F.lit("toxic")), edges.limit(0))
    store.delete_nodes(docs.join(labels.where("quality = 0 AND toxic = 0").select("doc_id").distinct(), "doc_id", "left_semi").select("id"))
    store.compact(2)
    nodes, linked = store.read("nodes"), store.read("edges")
    n = linked.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    out = linked.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    both = nodes.select("id", "type", "label").join(n, "id", "left").join(out, "id", "left")
    return both.select("id", "type", "label", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def lsh_index_search(spark, d):
    """Every distinct text asked of an index that the texts went into in two inserts, by language."""
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text"))
    texts = clones.distinct_texts(docs, "doc_id", "text")
    signed = written(clones.signatures(texts, "key", "text").join(docs.select(F.col("doc_id").alias("key"), "lang"), "key"))
    index = LshIndex(spark, scratch(spark))
    for part in (F.col("lang") == "en", ~F.coalesce(F.col("lang") == "en", F.lit(False))):
        index.insert(signed.where(part).select("key", "signature"))
    out = index.search(signed)
    return out.select(F.col("query").cast("long").alias("query"), F.col("key").cast("long").alias("key"), "similarity")


SEARCHED = ("the token is licensed", "passage license")


def ranked_search(spark, d):
    """The 20 best documents for two queries, from an index that documents went into in two commits; those
    of the second are there already with other texts."""
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "lang", "text"))
    index = TextIndex(spark, scratch(spark))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    index.put(docs.select("key", F.when(english, F.col("text")).otherwise(F.lit("token token license")).alias("text")))
    index.put(docs.where(~english))
    found = [index.search(q).withColumn("query", F.lit(q)) for q in SEARCHED]
    return found[0].unionByName(found[1]).select("query", F.col("key").cast("long").alias("doc_id"), "score", "rank")


_Q = [store_commits, lsh_index_search, ranked_search]
QUERIES = {f.__name__: f for f in _Q}

ORACLES = {
    "store_commits": """
      WITH bad AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), plain AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0 AND toxic = 0),
      left_ AS (SELECT * FROM documents WHERE doc_id NOT IN (FROM plain)),
      linked AS (SELECT * FROM left_ WHERE doc_id NOT IN (FROM bad))
      SELECT 'doc:' || doc_id AS id, 'file' AS type, CASE WHEN doc_id IN (FROM bad) THEN 'toxic' ELSE lang END AS label, 0::BIGINT AS n_in,
        CASE WHEN doc_id IN (FROM bad) THEN 0 ELSE 1 END::BIGINT AS n_out FROM left_
      UNION ALL SELECT 'src:' || source, 'class', source, (SELECT count(*) FROM linked l WHERE l.source = d.source), 0 FROM documents d GROUP BY source""",
    "lsh_index_search": f"{_LSH}, f AS (SELECT * FROM pairs WHERE similarity >= 0.5::DOUBLE) SELECT doc_a AS query, doc_b AS key, similarity FROM f UNION ALL SELECT doc_b, doc_a, similarity FROM f",
    "ranked_search": rf"""
      WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
      a AS (SELECT count(*) AS n, sum(len(w)) / count(*)::DOUBLE AS mean FROM d),
      q AS (SELECT DISTINCT q AS query, unnest(regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}]+')) AS term FROM (SELECT unnest([{', '.join(f"'{q}'" for q in SEARCHED)}]) AS q)),
      h AS (SELECT query, doc_id, term, len(w)::DOUBLE AS len, len(list_filter(w, lambda x: x = term))::DOUBLE AS tf FROM d, q),
      r AS (SELECT query, term, count(*) AS df FROM h WHERE tf > 0 GROUP BY ALL),
      s AS (
        SELECT query, doc_id, floor(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * len / mean))) * 1e{DIGITS}::DOUBLE + 0.5::DOUBLE) / 1e{DIGITS}::DOUBLE AS score
        FROM h JOIN r USING (query, term), a WHERE tf > 0 GROUP BY ALL),
      o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id::VARCHAR) AS rank FROM s)
      SELECT * FROM o WHERE rank <= 20""",
}

