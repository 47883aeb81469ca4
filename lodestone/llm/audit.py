"""Operator 12: how filters interact, replayed over every order in which they may stand.

Each document's five flags say which filters it fails.  The documents are crossed with the 120 orders - a
fixed table, broadcast - and each meeting is exploded into five steps; the first step whose filter a
document fails removes it.  Counts are aggregated conditionally where the rows are made, so that only one
row for each task, part, order and step is shuffled.

Filters: A fails under 100 words, B with under 80 % distinct words, C with over 10 % capitals A-Z, D with
any of ``#$%&*|``, E where a smaller doc_id has the same text, removed or not.  Words are runs without
space and \\t to \\r.

Whole texts are compared by SHA-256.  Texts that over 1 of 4 x partitions of all rows share are so few that
their smallest ids are broadcast; the other copies meet theirs by a join.  Rows that agree in id, part and
flags are counted before labels are joined, so that no id is one task's.

Defined cases: a null text is the empty text, a null lang the empty part; without words B holds, and
without code points C; a null id is smaller than none and larger than none, and has no labels; repeated rows
count each, and fail E only if a smaller id has their text; of several labels of an id any 1 counts; labels of
no document are not read; texts of any length are read whole; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import partitions, table, written

FILTERS = "ABCDE"
#: Bounds of the filters A, B, C and the characters of D.
WORDS, DISTINCT, CAPITALS, MARKS = 100, 80, 10, "#$%&*|"
#: Texts that more than one of so many rows a partition share are broadcast.
HEAVY = 4
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failed_by_text(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """key, part, digest, failed: the filters A to D as the lowest bits of a number."""
    own = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    own = own.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [
        F.size("words") < WORDS,
        100 * F.size(F.array_distinct("words")) < DISTINCT * F.size("words"),
        100 * capitals.cast("long") > CAPITALS * F.length("text").cast("long"),
        F.col("text").rlike(f"[{MARKS}]"),
    ]
    return own.select("key", "part", F.sha2("text", 256).alias("digest"), _mask(fails).alias("failed"))


def _mask(fails: list[Column]) -> Column:
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails)]
    return sum(bits[1:], bits[0])


def with_copies(rows: DataFrame) -> DataFrame:
    """key, part, failed: with E added where a smaller key has the same digest."""
    rows = written(rows)
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
    copies = written(copies.where("least < most").drop("most"))
    bound = rows.count() // (HEAVY * partitions(rows.sparkSession))
    heavy = F.broadcast(copies.where(F.col("n") > bound).drop("n"))  # fewer than HEAVY for each partition
    light = copies.where(F.col("n") <= bound).drop("n")
    met = rows.join(heavy, "digest").unionByName(rows.join(heavy, "digest", "left_anti").join(light, "digest", "left"), allowMissingColumns=True)
    again = F.coalesce(F.col("key") > F.col("least"), F.lit(False))
    return met.select("key", "part", (F.col("failed") + F.when(again, F.lit(1 << 4)).otherwise(F.lit(0))).alias("failed"))


def labelled(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """part, failed, good, toxic, n: rows that agree in key, part and flags are counted first."""
    counted = rows.groupBy("key", "part", "failed").agg(F.count(F.lit(1)).alias("n"))
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    return counted.join(known, "key", "left").select("part", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")


def orders(spark: SparkSession) -> DataFrame:
    """filter_order and the bits of its five filters, in order: 120 rows."""
    rows = [F.struct(F.lit("".join(p)).alias("filter_order"), F.array(*[F.lit(1 << FILTERS.index(f)) for f in p]).alias("bits")) for p in permutations(FILTERS)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("o")).select("o.*")


def replay(documents: DataFrame) -> DataFrame:
    """part, filter_order, step, the counts and shapley, for documents(part, failed, good, toxic, n)."""
    crossed = documents.join(F.broadcast(orders(documents.sparkSession)))
    first = F.lit(len(FILTERS) + 1)
    for i in reversed(range(len(FILTERS))):
        first = F.when(F.col("failed").bitwiseAND(F.col("bits")[i]) != 0, F.lit(i + 1)).otherwise(first)
    stepped = crossed.withColumn("first", first).select("*", F.posexplode("bits").alias("i", "bit"))
    step, fails = F.col("i") + 1, F.col("failed").bitwiseAND(F.col("bit")) != 0
    here = F.col("first") == step
    when = {
        "kept": F.col("first") > step,
        "removed": here,
        "redundant": fails & (F.col("first") < step),
        "unique_fails": F.col("failed") == F.col("bit"),
        "good_lost": here & F.col("good"),
        "toxic_lost": here & F.col("toxic"),
    }
    counts = [F.sum(F.when(when[c], F.col("n")).otherwise(F.lit(0))).alias(c) for c in COUNTS]
    out = stepped.groupBy("part", "filter_order", step.cast("int").alias("step"), "bit").agg(*counts)
    # A filter's rows over all orders: 120 for each part.
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The counts of every part, order and step."""
    return replay(labelled(with_copies(failed_by_text(docs, key, text, part)), labels, key))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = rf"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
    known AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
    f AS (
      SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        map {{'A': len(words) < {WORDS}, 'B': 100 * len(list_distinct(words)) < {DISTINCT} * len(words),
             'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITALS} * length(text),
             'D': regexp_matches(text, '[{MARKS}]'), 'E': coalesce(w.doc_id > least, false)}} AS fails
      FROM w LEFT JOIN known ON w.doc_id = known.doc_id),
    g AS (SELECT part, good, toxic, fails, list_count(list_filter(map_values(fails), lambda x: x)) AS n_fails, count(*) AS n FROM f GROUP BY ALL),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    o AS (
      SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
    s AS (
      SELECT g.*, filter_order, step, filter_order[step] AS filter, fails[filter_order[step]] AS own,
        len(list_filter(range(1, step), lambda i: fails[filter_order[i]])) > 0 AS before
      FROM g, o, range(1, 6) AS t(step)),
    r AS (
      SELECT part, filter_order, step::INT AS step, filter,
        coalesce(sum(n) FILTER (NOT own AND NOT before), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT before), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (own AND before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND n_fails = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (own AND NOT before AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (own AND NOT before AND toxic), 0)::BIGINT AS toxic_lost
      FROM s GROUP BY ALL)
    SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
    """

QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {"op12_filter_audit": ORACLE}
