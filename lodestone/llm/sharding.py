"""Operator 1: placement of rows on shards by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, given by an offset and a skip
from hashes of its name.  The shards take turns; at its turn a shard claims the first slot of its
permutation that is still free.  Each shard so gets the same number of slots (but for one), and
when a shard leaves, few slots of the others move.

The table has a fixed number of slots whatever the data's size, so it is broadcast; a row finds its
shard by one hash and one probe, with no shuffle.  Placement and its join are DataFrame operations.

Defined cases: a null key counts as the empty key; repeated rows get the same shard; an empty input
gives an empty output; keys of any length are hashed whole; all input columns are kept, whatever their
names.  A result column that the input already has, in upper or lower case, is replaced in the output.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lodestone.llm.common import scratch, table

#: Slots of the lookup table: a prime, at least 100 times the number of shards.  The table takes
#: 16 bytes a slot, 1 MB in all, and does not grow with the data.
SLOTS = 65537
RESULT = ("slot", "shard", "shard_name")
SHARDS = tuple(f"shard-{i:03d}" for i in range(256))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if slots < len(shards) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, no smaller than the number of shards")
    at = [_hash(f"offset:{name}") % slots for name in shards]
    skip = [_hash(f"skip:{name}") % (slots - 1) + 1 for name in shards]
    owner = [-1] * slots
    free = slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                return owner


def lookup_table(spark: SparkSession, shards: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    """slot, shard: the table as a DataFrame, read from one binary literal of two bytes a slot."""
    packed = b"".join(i.to_bytes(2, "big") for i in fill(shards, slots)).hex()
    return spark.sql(
        f"SELECT id AS slot, CAST(conv(hex(substring(X'{packed}', CAST(2 * id + 1 AS INT), 2)), 16, 10) AS INT) AS shard "
        f"FROM range(0, {slots}, 1, 1)"
    )


def assign_shards(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with columns slot (long), shard (int) and shard_name."""
    if len(shards) > 65536:
        raise ValueError("at most 65536 shards")
    lookup = lookup_table(df.sparkSession, shards, slots)
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10)
    kept = [c for c in df.columns if c.lower() not in RESULT]
    # The input's columns travel within a struct, where no name of theirs meets one used here.
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), (hashed.cast("long") % F.lit(slots)).alias("slot"))
    placed = whole.join(F.broadcast(lookup), "slot")
    names = F.array(*[F.lit(x) for x in shards])
    return placed.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        F.col("slot"),
        F.col("shard"),
        F.element_at(names, F.col("shard") + 1).alias("shard_name"),
    )


def write_shards(df: DataFrame, key: str, path: str, shards: tuple[str, ...] = SHARDS, splits: int = 4) -> None:
    """Writes one folder a shard.  Each shard's rows go to ``splits`` tasks in turn, by their places in
    the input, so that a shard which a hot key or equal rows fill is not one task's work.  df is a scan, or
    another table whose tasks give their rows in the same order when they run again."""
    turn = "turn"
    while turn in {c.lower() for c in df.columns}:
        turn += "_"
    out = assign_shards(df, key, shards).withColumn(turn, F.pmod(F.monotonically_increasing_id(), F.lit(splits)))
    out.repartition("shard", turn).drop(turn).write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType, shards: tuple[str, ...] = SHARDS) -> DataFrame:
    """The rows that write_shards wrote, with slot, shard (from the folder) and shard_name; schema is
    that of the rows before."""
    own = [f for f in schema if f.name.lower() not in RESULT]
    rows = spark.read.schema(StructType([*own, StructField("slot", LongType()), StructField("shard", IntegerType())])).parquet(path)
    names = F.element_at(F.array(*[F.lit(x) for x in shards]), (F.col("id") + 1).cast("int"))
    named = spark.range(0, len(shards), 1, 1).select(F.col("id").cast("int").alias("shard"), names.alias("shard_name"))
    return rows.join(F.broadcast(named), "shard").select(*[f"`{f.name}`" for f in own], "slot", "shard", "shard_name")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents are written as shards; the placement is read back from these."""
    docs = table(spark, sf_dir, "documents")
    write_shards(docs, "doc_id", path := scratch(spark))
    return read_shards(spark, path, docs.schema).select("doc_id", "slot", "shard", "shard_name")


def _oracle() -> str:
    packed = "".join(f"{i:02x}" for i in fill(SHARDS))
    return f"""
    WITH t AS (SELECT '{packed}' AS packed),
    placed AS (
      SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents),
    owned AS (
      SELECT range AS slot, ('0x' || substr(t.packed, CAST(2 * range + 1 AS INT), 2))::INT AS shard
      FROM t, range({SLOTS}))
    SELECT doc_id, slot, shard, printf('shard-%03d', shard) AS shard_name FROM placed JOIN owned USING (slot)
    """


QUERIES = {"op1_sharding": op1_sharding}
ORACLES = {"op1_sharding": _oracle}
