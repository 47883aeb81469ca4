"""A stored inverted index with bm25: postings by term, bounds for early stopping, upkeep by document.

Documents get a range when they are put: RANGE ones of a task, whose postings are made there and shuffled as
such, not word by word.  The postings of a term within
a range are one row - keys, counts, lengths, and of these the largest count and the smallest length - in
one of PARTS folders by a hash of the term.  A search reads

1. of its terms' rows the bounds alone, which give the documents that hold each term, and for each range
   the most that a document of it can score;
2. the postings of the FIRST best ranges, whose k-th best score is one that every answer must reach;
3. the postings of the ranges that can reach it, and ranks their documents.

Putting a document again, or removing it, rewrites the rows of its old range (RANGE documents at most), so
counts and bounds are exact at every version.  Numbers of documents and words are kept as a row of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import half_up
from lodestone.operators.log import Change, Kept, Snapshot, TableLog
from lodestone.tables import written

#: Folders of postings, documents of a range, ranges that set the bar.
PARTS, RANGE, FIRST = 64, 128, 16
#: Fixed values of bm25.
K1, B = 1.2, 0.75
#: What scores are compared by: their rounding must never cost an answer.
DIGITS, SLACK = 6, 1e-6


def terms(text: Column) -> Column:
    """Runs of letters and digits, in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def impact(count: Column, length: Column, mean: float) -> Column:
    """What a document with so many of a term's words scores, for an idf of 1; grows with the count and
    falls with the length."""
    return count * (K1 + 1) / (count + K1 * (1 - B + B * length / F.lit(mean)))


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _row(each: Column) -> list[Column]:
    """The columns of a row of postings, from an array of (key, count, length)."""
    return [F.size(each).alias("n"), F.array_max(each["count"]).alias("most"), F.array_min(each["length"]).alias("least"), each["key"].alias("keys"), each["count"].alias("counts"), each["length"].alias("lengths")]


def _inverted(docs: pa.Table, number: int) -> pa.RecordBatch:
    """The rows of a range, and one without a term that has its documents."""
    docs = docs.combine_chunks().sort_by("key").combine_chunks()
    keys, listed = docs.column("key").chunk(0), docs.column("terms").chunk(0)
    length = np.diff(np.asarray(listed.offsets)).astype(np.int32)
    coded = listed.flatten().dictionary_encode()
    at, count = np.unique(np.asarray(coded.indices).astype(np.int64) * len(keys) + np.repeat(np.arange(len(keys)), length), return_counts=True)
    doc = np.append(at % len(keys), np.arange(len(keys)))
    ends = pa.array(np.append(np.append(0, np.cumsum(np.bincount(at // len(keys), minlength=len(coded.dictionary)))), len(doc)), pa.int32())
    lists = lambda v: pa.ListArray.from_arrays(ends, v)
    columns = [
        pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]),
        pa.array(np.full(len(ends) - 1, number), pa.int64()),
        lists(keys.cast(pa.string()).take(pa.array(doc))),
        lists(pa.array(np.append(count, np.zeros(len(keys))).astype(np.int32))),
        lists(pa.array(length[doc])),
    ]
    return pa.RecordBatch.from_arrays(columns, ["term", "range", "keys", "counts", "lengths"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task, RANGE at a time; ranges are numbered by task and place."""
    rest, n = None, 0
    for batch in batches:
        own = pa.Table.from_batches([batch])
        rest = own if rest is None else pa.concat_tables([rest, own])
        while rest.num_rows >= RANGE:
            yield _inverted(rest.slice(0, RANGE), (rest.column("task")[0].as_py() << 16) + n)
            rest, n = rest.slice(RANGE), n + 1
    if rest is not None and rest.num_rows:
        yield _inverted(rest, (rest.column("task")[0].as_py() << 16) + n)


class TextIndex(TableLog):
    TABLES = {
        "documents": Kept("part INT, key STRING, range LONG, length INT", ("part", "key"), ("part",)),
        "postings": Kept("part INT, term STRING, range LONG, n INT, most INT, least INT, keys ARRAY<STRING>, counts ARRAY<INT>, lengths ARRAY<INT>", ("part", "term", "range"), ("part",)),
        "totals": Kept("name STRING, documents LONG, words LONG", ("name",)),
    }

    @staticmethod
    def _documents(new: DataFrame) -> DataFrame:
        each = new.where("term IS NULL").select("range", F.explode(F.arrays_zip("keys", "lengths")).alias("d"))
        return each.select(_part(F.col("d.keys")).alias("part"), F.col("d.keys").alias("key"), "range", F.col("d.lengths").alias("length"))

    def _old(self, s: Snapshot, keys: DataFrame) -> DataFrame:
        return s.read("documents").join(keys, ["part", "key"], "left_semi")

    def _without(self, s: Snapshot, old: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of postings of the documents' ranges without these, and the keys of rows left empty."""
        lost = old.groupBy("range").agg(F.collect_set("key").alias("lost"))  # RANGE keys at most
        rows = s.read("postings").join(lost, "range").where(F.arrays_overlap("keys", "lost"))
        each = F.arrays_zip(F.col("keys").alias("key"), F.col("counts").alias("count"), F.col("lengths").alias("length"))
        rows = rows.withColumn("each", F.filter(each, lambda x: ~F.array_contains("lost", x["key"])))
        rows = written(rows.select("part", "term", "range", "each"))
        return rows.where(F.size("each") > 0).select("part", "term", "range", *_row(F.col("each"))), rows.where(F.size("each") == 0)

    def _change(self, s: Snapshot, keys: DataFrame, new: DataFrame | None) -> Change:
        out, before = Change(), s.read("totals").first()
        n, words = (before.documents, before.words) if before else (0, 0)
        old = written(self._old(s, keys))
        lost = old.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        n, words = n - lost.n, words - lost.words
        put = []
        if lost.n:
            kept, empty = self._without(s, old)
            put, out.gone["postings"] = [kept], empty
        if new is None:
            out.gone["documents"] = keys
        else:
            new = new.withColumn("range", F.lit((s.version + 1) << 32) + F.col("range"))
            docs = self._documents(new)
            added = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
            n, words = n + added.n, words + added.words
            rows = [F.size("keys").alias("n"), F.array_max("counts").alias("most"), F.array_min("lengths").alias("least"), "keys", "counts", "lengths"]
            put.append(new.where("term IS NOT NULL").select(_part(F.col("term")).alias("part"), "term", "range", *rows))
            out.put["documents"] = docs
        if put:
            out.put["postings"] = put[0] if len(put) == 1 else put[0].unionByName(put[1])
        out.put["totals"] = self.spark.createDataFrame([("all", n, words)], self.TABLES["totals"].schema)
        return out

    def put(self, docs: DataFrame, key: str = "key", text: str = "text") -> int:
        """Adds documents, or puts them in place of those of their keys; of repeated keys the largest text."""
        own = docs.select(F.col(key).cast("string").alias("key"), F.coalesce(text, F.lit("")).alias("text")).where("key IS NOT NULL")
        own = own.groupBy("key").agg(F.max("text").alias("text")).select("key", terms(F.col("text")).alias("terms"), F.spark_partition_id().cast("long").alias("task"))
        new = written(own.mapInArrow(_ranges, "term string, range long, keys array<string>, counts array<int>, lengths array<int>"))
        keys = self._documents(new).select("part", "key")
        return self.change(lambda s: self._change(s, keys, new))

    def remove(self, keys: DataFrame, key: str = "key") -> int:
        own = written(keys.select(F.col(key).cast("string").alias("key")).where("key IS NOT NULL").distinct().select(_part(F.col("key")).alias("part"), "key"))
        return self.change(lambda s: self._change(s, own, None))

    def postings(self, s: Snapshot, words: list[str]) -> DataFrame:
        """The rows of some terms: their parts' folders, and of these the terms' row groups, are read."""
        parts = [r.part for r in self.spark.createDataFrame([(w,) for w in words], "term string").select(_part(F.col("term")).alias("part")).distinct().collect()]
        return s.read("postings").where(F.col("part").isin(parts) & F.col("term").isin(words))

    def search(self, query: str, k: int = 20, every: bool = False) -> DataFrame:
        """key, score, rank: the k best documents that hold any of the query's terms, or every one; ties by
        key.  Scores are rounded."""
        s = self.snapshot()
        words = [r.t for r in self.spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(terms(F.col("q")))).alias("t")).collect()]
        total = s.read("totals").first()
        if not words or not total or not total.words:
            return self.spark.createDataFrame([], "key string, score double, rank long")
        mean, rows = total.words / total.documents, self.postings(s, words)
        heads = written(rows.select("term", "range", "n", "most", "least"))
        held = {r.term: r.n for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each word asked
        if every and len(held) < len(words) or not held:
            return self.spark.createDataFrame([], "key string, score double, rank long")
        idf = F.element_at(F.create_map(*[x for t, n in held.items() for x in (F.lit(t), F.log(F.lit(1 + (total.documents - n + 0.5) / (n + 0.5))))]), F.col("term"))
        most = F.sum(idf * impact(F.col("most").cast("double"), F.col("least").cast("double"), mean))
        ranges = heads.groupBy("range").agg(most.alias("bound"), F.count(F.lit(1)).alias("terms"))
        ranges = written(ranges.where(F.col("terms") == len(words)) if every else ranges)

        def scored(asked: DataFrame) -> DataFrame:
            own = rows.join(asked.select("range"), "range", "left_semi").select("term", F.explode(F.arrays_zip("keys", "counts", "lengths")).alias("d"))
            own = own.groupBy(F.col("d.keys").alias("key")).agg(F.sum(idf * impact(F.col("d.counts").cast("double"), F.col("d.lengths").cast("double"), mean)).alias("score"), F.count(F.lit(1)).alias("terms"))
            own = own.where(F.col("terms") == len(words)) if every else own
            return own.select("key", half_up(F.col("score"), DIGITS).alias("score"))

        best = scored(ranges.orderBy(F.desc("bound"), "range").limit(FIRST)).orderBy(F.desc("score"), "key").limit(k)
        bar = best.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        able = ranges if bar.n < k else ranges.where(F.col("bound") >= bar.least - SLACK)
        out = scored(able).orderBy(F.desc("score"), "key").limit(k)  # k rows
        return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")).cast("long"))
