"""Operator 11: lines that many documents share, found by a range-partitioned sort of line hashes.

Every row of the input is a document and gets a number.  Of its text only hashes leave: one row for each
document and distinct key of its lines, with the positions of these lines.  The rows are range-partitioned
and sorted by hash, document and position, and each partition is streamed once: it meets the documents of a
key one after another, the first occurrence first, and needs to hold no more than the rows that come before
a verdict.  As the document is part of the range, a key that a third of all rows have is dealt over many
partitions.  What a partition can't know is whether its first and its last key go on in another one: of
these it hands on a count and the few undecided rows, which are settled by a table of two rows for each
partition.  The result is not text but a compressed bitmap of the lines to keep for each document.

A key is a line without white space (space, \\t to \\r) at both ends, A-Z lower-cased; its hash has 128 bits.
Texts are split at \\n.  Keys in at least ``least`` documents lose all their lines, or, with ``first``, all
but the first occurrence by document and position.

Defined cases: a null or an empty text is one empty line; keys shorter than ``shortest`` code points are
never dropped, so empty lines stay; a key that occurs often in one document counts once for it; repeated
rows, and rows that share an id or have none, are documents of their own; texts of any length are read
whole, a document at a time; an empty table gives no rows; other columns are kept whatever their names, and
where the input has a column of a result's name, the result's takes its place.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table, tidied, written

#: A key in so many documents goes; code points of a key at least.
LEAST, SHORTEST = 10, 1
_SPACE = b" \t\n\r\x0b\x0c"
_KEYS_DDL = "hi long, lo long, number long, at binary"
_KEYS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("number", pa.int64()), ("at", pa.binary())])
#: Kinds of rows: lines to drop, undecided lines, counts of keys at a partition's edges.
_DROP, _OPEN, _EDGE = 0, 1, 2
_MET_DDL = "kind int, hi long, lo long, number long, at binary, n long"
_MET = pa.schema([("kind", pa.int32()), *_KEYS, ("n", pa.int64())])


def line_keys(text: bytes, shortest: int = SHORTEST) -> dict[bytes, list[int]]:
    """The distinct keys of a text's lines, each with the positions of its lines."""
    out: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip(_SPACE).lower()
        if key and (shortest <= 1 or len(key.decode()) >= shortest):
            out.setdefault(key, []).append(i)
    return out


def numbered(docs: DataFrame, text: str = "text") -> DataFrame:
    """number, text (never null), n_lines and a struct of all columns, as a written table."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    own = docs.select(F.monotonically_increasing_id().alias("number"), whole.alias("text"), row.alias("row"))
    return written(own.withColumn("n_lines", F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + F.lit(1).cast("long")))


def hashed_keys(rows: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """hi, lo, number, at: a row for each document and distinct key; at packs positions as 4-byte numbers."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            hashes, numbers, at = [], [], []
            for number, text in zip(batch.column("number").to_pylist(), batch.column("text")):
                for key, places in line_keys(text.as_py().encode(), shortest).items():
                    hashes.append(hashlib.blake2b(key, digest_size=16).digest())
                    numbers.append(number)
                    at.append(np.array(places, dtype="<i4").tobytes())
            both = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(numbers, type=pa.int64()), pa.array(at, type=pa.binary())], schema=_KEYS)

    return rows.select("number", "text").mapInArrow(tidied(run), _KEYS_DDL)


class _Run:
    """The rows of one key within a partition, as they stream by."""

    def __init__(self, key: tuple[int, int], edge: bool, least: int, first: bool):
        self.key, self.edge, self.least, self.first = key, edge, least, first
        self.n, self.held, self.head, self.start = 0, [], None, None

    def take(self, rows: pa.RecordBatch) -> list[pa.RecordBatch]:
        """The rows that are now known to be dropped."""
        if not self.n:
            self.start = rows.column("number")[0].as_py()
            if self.first:  # the first occurrence is settled when the run ends
                self.head, rows, self.n = rows.slice(0, 1), rows.slice(1), 1
        self.n += len(rows)
        self.held.append(rows)
        if self.n < self.least:
            return []
        out, self.held = self.held, []
        return out

    def close(self, edge: bool) -> list[pa.RecordBatch]:
        """What is left to say when the run ends, at the partition's edge or within it."""
        head = [self.head] if self.head is not None else []
        if self.edge or edge:
            note = pa.RecordBatch.from_pylist([{"kind": _EDGE, "hi": self.key[0], "lo": self.key[1], "number": self.start, "n": self.n}], schema=_MET)
            return [note, *[_as(_OPEN, rows) for rows in [*head, *self.held]]]
        return [_as(_DROP, _but_first(rows)) for rows in head] if self.n >= self.least else []


def _as(kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int32)), *[rows.column(c) for c in _KEYS.names], pa.nulls(n, pa.int64())], schema=_MET)


def _but_first(rows: pa.RecordBatch) -> pa.RecordBatch:
    """A row with all positions but the first; none, if it has one."""
    at = rows.column("at")[0].as_py()[4:]
    return rows.set_column(_KEYS.names.index("at"), "at", pa.array([at], type=pa.binary())) if at else rows.slice(0, 0)


def streamed(batches: Iterator[pa.RecordBatch], least: int, first: bool) -> Iterator[pa.RecordBatch]:
    """One sorted partition: lines to drop, and what concerns its first and last key."""
    run, begun = None, False
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        hi, lo = (batch.column(c).to_numpy() for c in ("hi", "lo"))
        new = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
        ends = np.append(new[1:], n)
        # Only runs of enough rows, and those at a batch's ends, are looked at one by one.
        few = ends - new < least
        if first:  # of one row with one line nothing goes
            few |= (ends - new == 1) & (pc.binary_length(batch.column("at")).to_numpy()[new] <= 4)
        few[[0, -1]] = False
        for a, b in zip(new[~few], ends[~few]):
            key = int(hi[a]), int(lo[a])
            if run is not None and run.key != key:
                yield from run.close(False)
                run = None
            if run is None:
                run, begun = _Run(key, not begun, least, first), True
            yield from (_as(_DROP, rows) for rows in run.take(batch.slice(a, b - a)) if len(rows))
    if run is not None:
        yield from run.close(True)


def repeated(keys: DataFrame, least: int = LEAST, first: bool = False) -> DataFrame:
    """number, at: the positions of lines to drop."""
    order = ["hi", "lo", "number"]
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    met = written(dealt.mapInArrow(tidied(lambda batches: streamed(batches, least, first)), _MET_DDL))
    # Two rows for each partition at most, whatever the data's size.
    edges = met.where(F.col("kind") == _EDGE).groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.min("number").alias("start"))
    left = met.where(F.col("kind") == _OPEN).select("hi", "lo", "number", "at").join(F.broadcast(edges.where(F.col("n") >= least)), ["hi", "lo"])
    at = F.when(F.lit(first) & (F.col("number") == F.col("start")), F.substring("at", 5, 1 << 30)).otherwise(F.col("at"))
    left = left.select("number", at.alias("at")).where(F.length("at") > 0)
    return met.where(F.col("kind") == _DROP).select("number", "at").unionByName(left)


def bitmap(n: int, dropped: bytes) -> bytes:
    """A compressed bitmap of n lines, the lowest bit first: 1 stays, 0 goes."""
    keep = np.ones(n, dtype=bool)
    keep[np.frombuffer(dropped, dtype="<i4")] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def kept_text(text: str, keep: bytes) -> str:
    own = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=len(own), bitorder="little")
    return text if bits.all() else "\n".join(own[i] for i in np.flatnonzero(bits))


def bitmaps(rows: DataFrame, least: int = LEAST, first: bool = False, shortest: int = SHORTEST) -> DataFrame:
    """number, n_dropped, keep: for each of the numbered rows how many lines go, and the bitmap."""
    gone = repeated(hashed_keys(rows, shortest), least, first).groupBy("number").agg(F.collect_list("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            dropped = [b"".join(at or []) for at in batch.column("at").to_pylist()]
            keep = [bitmap(n, d) for n, d in zip(batch.column("n_lines").to_pylist(), dropped)]
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array([len(d) // 4 for d in dropped], type=pa.int64()), pa.array(keep, type=pa.binary())], names=["number", "n_dropped", "keep"])

    return rows.select("number", "n_lines").join(gone, "number", "left").mapInArrow(tidied(run), "number long, n_dropped long, keep binary")


def line_bitmaps(docs: DataFrame, text: str = "text", least: int = LEAST, first: bool = False, shortest: int = SHORTEST) -> DataFrame:
    """All columns but the text, with n_lines, n_dropped and keep, the compressed bitmap."""
    rows = numbered(docs, text)
    out = rows.drop("text").join(bitmaps(rows, least, first, shortest), "number")
    return _named(out, docs, text, ["n_lines", "n_dropped", "keep"])


def without_repeated_lines(docs: DataFrame, text: str = "text", least: int = LEAST, first: bool = False, shortest: int = SHORTEST) -> DataFrame:
    """All columns, the text without the dropped lines, and n_lines and n_dropped."""
    rows = numbered(docs, text)
    both = rows.join(bitmaps(rows, least, first, shortest), "number")

    @F.pandas_udf("string")
    def kept(texts, keeps):
        return texts.combine(keeps, kept_text)

    out = both.withColumn("text", F.when(F.col("n_dropped") > 0, kept("text", "keep")).otherwise(F.col("text")))
    return _named(out, docs, text, ["text", "n_lines", "n_dropped"])


def _named(out: DataFrame, docs: DataFrame, text: str, results: list[str]) -> DataFrame:
    own = {r: text if r == "text" else r for r in results}
    taken = {c.lower() for c in own.values()} | {text.lower()}
    rest = [c for c in docs.columns if c.lower() not in taken]
    return out.select(*[F.col("row").getField(c).alias(c) for c in rest], *[F.col(r).alias(c) for r, c in own.items()])


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = rf"""
    WITH l AS (
      SELECT r, doc_id, i, s[i] AS line, translate(trim(s[i], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), E'\n') AS s FROM documents), unnest(range(1, len(s) + 1)) AS t(i)),
    hot AS (SELECT key FROM l WHERE length(key) >= {SHORTEST} GROUP BY key HAVING count(DISTINCT r) >= {LEAST})
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM hot)) AS n_dropped,
      sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (key NOT IN (FROM hot)), '')) AS kept_sha256
    FROM l GROUP BY r, doc_id
    """

QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLES = {"op11_line_dedup": ORACLE}
