"""Structured Streaming: keeping an index current, idempotent events, event-time windows.

The windows and the stateful counter go beyond change detection; they are here because event tables are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.extract import fact_tables, facts
from lodestone.operators.graph import index
from lodestone.operators.sequences import sessions, sliding, tumbling
from lodestone.operators.store import GraphStore
from lodestone.tables import written

__all__ = ["current_index", "idempotent", "sessions", "sliding", "tumbling", "windowed_errors"]


def idempotency_key(*columns: str):
    """The first 16 digits of a hash of what makes a request."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


def idempotent(events: DataFrame, ts: str, *columns: str, ttl: str = "24 hours") -> DataFrame:
    """events without repetitions of the same columns within the time; state older than it goes."""
    keyed = events.withColumn("idempotency_key", idempotency_key(*columns)).withWatermark(ts, ttl)
    return keyed.dropDuplicatesWithinWatermark(["idempotency_key"])


def windowed_errors(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and errors by window, for events at most so late."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors")).select(F.col("w.start").alias("start"), "n_events", "n_errors")


def current_index(spark: SparkSession, corpus_path: str, store: GraphStore, checkpoint: str, schema: str) -> StreamingQuery:
    """Indexes new and changed files of a growing parquet corpus in a store, each batch once: their nodes
    and edges take the place of what was known of them, in one commit with the files' hashes, which writes
    no more than these.

    A batch only takes files whose hash the store doesn't hold, so running it again changes nothing.
    Imports are resolved to files of the batch and of the store.
    """

    def take(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("repository", "path").agg(F.max_by(F.struct("lang", "content"), F.sha2("content", 256)).alias("f")).select("repository", "path", "f.*")
        stale = store.stale(last).where("status <> 'unchanged'").select("repository", F.col("file_path").alias("path"), "file_hash")
        files = written(last.join(stale, ["repository", "path"]))
        if not files.limit(1).count():
            return
        imports, declared, related = fact_tables(written(facts(files)))
        known = store.read("indexed_files").select("repository", F.col("file_path").alias("path"))
        nodes, edges = index(imports, declared, related, files.select("repository", "path"), known)
        nodes, edges = written(nodes), written(edges)
        counts = nodes.groupBy("repository", F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("node_count"))
        rows = files.join(counts, ["repository", "path"], "left")
        rows = rows.select(F.col("path").alias("file_path"), "repository", "file_hash", F.coalesce("node_count", F.lit(0).cast("long")).alias("node_count"), F.current_timestamp().alias("indexed_at"))
        store.replace_files(written(rows), nodes, edges)
        store.compact(store.MERGED)

    files = spark.readStream.schema(schema).parquet(corpus_path)
    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
