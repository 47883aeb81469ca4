"""A stored index of signatures: insert and remove by key, query by bands, search by similarity.

Two tables of a log: the signatures, dealt to PARTS by a hash of the key, and a row for each key and band,
dealt by the band's value.  An insert writes the rows of its keys and takes back bands that a key no longer
has, which its old signature tells; it reads the parts of these keys alone.  A query reads the parts of the
bands that it asks for, and of the signatures only those of the candidates' parts: a part is a folder, so
the rest isn't touched.  A band value that very many keys share is dealt further when it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.clones import LEAST, bands, signatures, similarity
from lodestone.operators.log import Change, Kept, Snapshot, TableLog
from lodestone.tables import join_in_parts, written

#: Folders of each table.
PARTS = 64


def _part(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(PARTS)).cast("int")


def _only(table: DataFrame, asked: DataFrame) -> DataFrame:
    """The table's parts that another one names: PARTS numbers at most reach the driver."""
    parts = [r.part for r in asked.select("part").distinct().collect()]
    return table.where(F.col("part").isin(parts))


class LshIndex(TableLog):
    TABLES = {
        "signatures": Kept("part INT, key STRING, signature ARRAY<LONG>", ("part", "key"), ("part",)),
        "bands": Kept("part INT, band INT, value LONG, key STRING", ("part", "band", "value", "key"), ("part",)),
    }

    @staticmethod
    def _keyed(signed: DataFrame) -> DataFrame:
        own = signed.select(F.col("key").cast("string").alias("key"), "signature").where("key IS NOT NULL AND signature IS NOT NULL")
        return own.groupBy("key").agg(F.max("signature").alias("signature")).select(_part("key").alias("part"), "key", "signature")

    @staticmethod
    def _banded(keyed: DataFrame) -> DataFrame:
        return bands(keyed).select(_part("band", "value").alias("part"), "band", "value", "key")

    def insert(self, signed: DataFrame) -> int:
        """Puts key, signature in place of what the keys had; of repeated keys the largest signature."""
        new = written(self._keyed(signed))

        def made(s: Snapshot) -> Change:
            old = _only(s.read("signatures"), new).join(new.select("part", "key"), ["part", "key"], "left_semi")
            return Change(put={"signatures": new, "bands": self._banded(new)}, gone={"bands": self._banded(old)})

        return self.change(made)

    def remove(self, keys: DataFrame) -> int:
        gone = written(keys.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct().select(_part("key").alias("part"), "key"))

        def made(s: Snapshot) -> Change:
            old = _only(s.read("signatures"), gone).join(gone, ["part", "key"], "left_semi")
            return Change(gone={"signatures": gone, "bands": self._banded(old)})

        return self.change(made)

    def size(self) -> int:
        return self.read("signatures").count()

    def query(self, signed: DataFrame) -> DataFrame:
        """query, key: the indexed keys that share a band with a query (key, signature), but for its own."""
        return self._candidates(self.snapshot(), written(self._keyed(signed)))

    def _candidates(self, s: Snapshot, asked: DataFrame) -> DataFrame:
        own = written(self._banded(asked).withColumnRenamed("key", "query"))
        found = join_in_parts(own, _only(s.read("bands"), own), ["part", "band", "value"])
        return found.where("key <> query").select("query", "key").distinct()

    def search(self, signed: DataFrame, least: float = LEAST, limit: int | None = None) -> DataFrame:
        """query, key, similarity: candidates that agree with a query in enough functions; with a limit the
        best of each query, ties by key."""
        s, asked = self.snapshot(), written(self._keyed(signed))
        found = written(self._candidates(s, asked).withColumn("part", _part("key")))
        theirs = _only(s.read("signatures"), found).select("part", "key", F.col("signature").alias("b"))
        both = found.join(theirs, ["part", "key"]).join(asked.select(F.col("key").alias("query"), F.col("signature").alias("a")), "query")
        out = both.select("query", "key", similarity(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= least)
        if limit is None:
            return out
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key"))
        return out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)

    def search_text(self, text: str, least: float = LEAST, limit: int = 20) -> DataFrame:
        """The indexed keys most similar to a text."""
        one = self.spark.createDataFrame([("", text)], "key string, text string")
        return self.search(signatures(one, "key", "text"), least, limit).drop("query")
