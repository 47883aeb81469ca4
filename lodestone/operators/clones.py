"""Exact, token-level and structural clones, fragments, confidence, merging and text search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import half_up, normalised, words
from lodestone.operators.windows import common_runs, shared_counts
from lodestone.tables import join_in_parts, written

# Fixed values of the signature scheme: functions, prime, base of a shingle's number, bands, least similarity,
# shingle size; words of a clone.
FUNCTIONS, PRIME, BASE, BANDS, LEAST, SHINGLE, TILE = 128, 2147483647, 1000003, 16, 0.5, 5, 30
#: Different hashes whose values are kept at once (512 bytes each), and occurrences that are looked up in them.
KNOWN, OCCUR = 1 << 18, 1 << 22
#: Texts of near copies whose sets are compared in one task.
TOGETHER = 1024
#: Rows of one value that meet in one task.
HOT = 1024
COEFFICIENTS = [((i * 2654435761 + 97) % (PRIME - 1) + 1, (i * 40503 * 65537 + 11) % PRIME) for i in range(1, FUNCTIONS + 1)]


def distinct_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text: of equal texts the one with the smallest key."""
    return df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.min(key).alias("key"))


def exact_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """hash, n, first: groups of at least two equal texts.  Only digests are shuffled."""
    own = df.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("hash"), F.col(key).alias("k"))
    return own.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first")).where("n > 1")


def members(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, representative: every row with the key that stands for its text in distinct_texts; rows
    without a text have none.  Only digests are shuffled."""
    own = df.select(F.col(key).alias("key"), F.sha2(F.col(text), 256).alias("hash"))
    least = own.where("hash IS NOT NULL").groupBy("hash").agg(F.min("key").alias("representative"))
    return own.join(least, "hash", "left").select("key", "representative")


def window_hashes(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, pos (from 0), h1, h2: two hashes of each run of so many words."""
    # The words are a column of their own, so that the lambda below doesn't split the text anew.
    return runs_of_windows(df.select(F.col(key).alias("key"), words(F.lower(F.col(text))).alias("w")), size)


def runs_of_windows(own: DataFrame, size: int) -> DataFrame:
    """key, pos (from 0), h1, h2: two hashes of each run of so many words of own(key, w)."""
    # Each word is hashed once, not once for every run that it is in.
    own = own.where(F.size("w") >= size).select("key", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    run = lambda i: F.slice("w", i, size)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (size - 1)), lambda i: F.struct(F.xxhash64(run(i)).alias("h1"), F.hash(run(i)).alias("h2")))
    each = own.select("key", F.posexplode(runs).alias("pos", "h"))
    return each.select("key", F.col("pos").cast("long").alias("pos"), "h.h1", "h.h2")


def _named_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, t, w: rows of equal texts have one t; w is split into words where they are hashed."""
    own = df.where(F.col(text).isNotNull())
    return own.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("t"), F.lower(F.col(text)).alias("w"))


def shared_windows(df: DataFrame, key: str, text: str, size: int = TILE) -> DataFrame:
    """n_docs, n_windows: how many windows so many distinct texts share."""
    return shared_counts(_named_words(df, key, text), size)


def token_clones(df: DataFrame, key: str, text: str, size: int = TILE, longest: bool = False) -> DataFrame:
    """doc_a, doc_b, start_a, start_b, n_tokens: maximal common runs of at least ``size`` words of two
    distinct texts, or of each pair the longest; of equal texts the smallest key stands for all."""
    return common_runs(_named_words(df, key, text), size, longest)


def met_runs(met: DataFrame, size: int) -> DataFrame:
    """doc_a, doc_b, start_a, start_b, n_tokens: maximal runs of windows that have met
    (doc_a, pos_a, doc_b, pos_b)."""
    met = met.withColumn("diagonal", F.col("pos_a") - F.col("pos_b"))
    nth = F.row_number().over(Window.partitionBy("doc_a", "doc_b", "diagonal").orderBy("pos_a"))
    runs = met.withColumn("run", F.col("pos_a") - nth).groupBy("doc_a", "doc_b", "diagonal", "run")
    out = runs.agg(F.min("pos_a").alias("start_a"), F.min("pos_b").alias("start_b"), (F.count(F.lit(1)) + (size - 1)).alias("n_tokens"))
    return out.select("doc_a", "doc_b", "start_a", "start_b", "n_tokens")


def met_by(each: DataFrame, on: list[str], key: str, *more: str) -> DataFrame:
    """doc_a, doc_b and the other columns of both: the pairs of different keys, smaller first, that agree
    in ``on``.  Where over HOT rows agree, one side is dealt into parts and the other copied to each, so
    that no group's pairs are one task's."""
    hot = written(each.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).withColumn("parts", F.ceil(F.col("n") / HOT).cast("int")).drop("n"))
    dealt = each.join(hot, on, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    side = lambda df, x: df.select(*on, "part", F.col(key).alias(f"doc_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in more])
    a = side(dealt.withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")), "a")
    b = side(dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "b")
    return a.join(b, [*on, "part"]).where("doc_a < doc_b").drop(*on, "part")


def skeleton(text: Column) -> Column:
    """Words as W, numbers as N, white space collapsed; other characters stay."""
    return normalised(F.regexp_replace(F.regexp_replace(text, r"\p{L}+", "W"), "[0-9]+", "N"))


def skeleton_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    own = df.where(F.col(text).isNotNull()).select(F.md5(skeleton(F.col(text)).cast("binary")).alias("skeleton"), F.col(key).alias("k"))
    return own.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first")).where("n > 1")


def shingle_hashes(text: str) -> np.ndarray:
    """The distinct hashes of a text's windows of SHINGLE characters, white space collapsed: a window's
    code points are the digits of a number to the base BASE, modulo PRIME."""
    t = re.sub(r"[ \t\n\r\f]+", " ", text).strip(" ")
    points = np.frombuffer(t.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    n = len(points) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint32)
    h = points[SHINGLE - 1 :].copy()
    for i in range(SHINGLE - 1):  # a point has 21 bits, so the sum has less than 55
        h += points[i : i + n] * np.uint64(pow(BASE, SHINGLE - 1 - i, PRIME))
    h = _folded(h)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def _folded(x: np.ndarray) -> np.ndarray:
    """Remainders by PRIME of numbers below 2**62.  PRIME is 2**31 - 1, so a number is congruent to the sum of
    its two parts of 31 bits, which is below twice PRIME; a difference below zero wraps round to a large one."""
    x = ((x & np.uint64(PRIME)) + (x >> np.uint64(31))).astype(np.uint32)
    return np.minimum(x, x - np.uint32(PRIME))


_A, _B = (np.array([c[i] for c in COEFFICIENTS], dtype=np.uint64) for i in (0, 1))


def function_values(h: np.ndarray) -> np.ndarray:
    """Of each hash the values of all functions, a row each."""
    out = np.empty((len(h), FUNCTIONS), dtype=np.uint32)
    for i in range(0, len(h), 256):  # parts stay in the cache; products stay below 2**62
        out[i : i + 256] = _folded(h[i : i + 256, None].astype(np.uint64) * _A + _B)
    return out


def least_values(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text's distinct hashes the least value of each function.  Texts have most shingles in common, so
    values are made once for up to KNOWN different hashes and looked up for each text."""
    ends, out, start, found = np.cumsum([len(h) for h in texts]), [], 0, np.empty((4096, FUNCTIONS), dtype=np.uint32)
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + OCCUR)))
        known = np.unique(np.concatenate(texts[start:stop]))
        while len(known) > KNOWN and stop > start + 1:
            stop = (start + stop) // 2
            known = np.unique(np.concatenate(texts[start:stop]))
        values = function_values(known) if len(known) <= KNOWN else None
        for h in texts[start:stop]:
            least = np.full(FUNCTIONS, PRIME, dtype=np.uint32)
            at = h if values is None else np.searchsorted(known, h)
            for i in range(0, len(at), len(found)):
                some = at[i : i + len(found)]
                rows = function_values(some) if values is None else np.take(values, some, axis=0, out=found[: len(some)], mode="clip")
                np.minimum(least, rows.min(axis=0), out=least)
            out.append(least.astype(np.int64))
        start = stop
    return out


def signatures(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, signature: for each of 128 universal hash functions the least value over the shingles;
    texts shorter than a shingle are left out."""

    kind = df.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            hashes = [shingle_hashes(t) for t in batch["text"]]
            some = [i for i, h in enumerate(hashes) if len(h)]
            if some:
                yield pd.DataFrame({"key": batch["key"].iloc[some].tolist(), "signature": least_values([hashes[i] for i in some])})

    own = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return own.mapInPandas(run, f"key {kind}, signature array<long>")


def similarity(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(float(FUNCTIONS))


def bands(signed: DataFrame) -> DataFrame:
    """key, band, value: a signature's bands, each as a hash of its values."""
    rows = FUNCTIONS // BANDS
    each = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("signature", i * rows + 1, rows)).alias("value")) for i in range(BANDS)])
    return signed.select("key", F.explode(each).alias("b")).select("key", "b.band", "b.value")


def lsh_pairs(signed: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_a, doc_b, similarity: pairs that share a band and agree in enough functions.  Bands of one
    text alone leave before the join."""
    each = bands(signed)
    several = each.groupBy("band", "value").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("band", "value")
    each = each.join(several, ["band", "value"], "left_semi")
    pairs = met_by(each, ["band", "value"], "key").select("doc_a", "doc_b").distinct()
    side = lambda x: signed.select(F.col("key").alias(f"doc_{x}"), F.col("signature").alias(f"s_{x}"))
    out = pairs.join(side("a"), "doc_a").join(side("b"), "doc_b").select("doc_a", "doc_b", similarity(F.col("s_a"), F.col("s_b")).alias("similarity"))
    return out.where(F.col("similarity") >= least)


def _marks(text: str) -> np.ndarray:
    """64-bit hashes of a text's windows of SHINGLE characters, white space collapsed; with repetitions."""
    t = re.sub(r"[ \t\n\r\f]+", " ", text).strip(" ")
    points = np.frombuffer(t.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    n = max(0, len(points) - SHINGLE + 1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        h = (h ^ points[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _common(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    """n_common and n_union of the pairs of a bucket, whose texts are there once."""
    place = {k: i for i, k in enumerate(texts.column("key").to_pylist())}
    marks = [_marks(t) for t in texts.column("text").to_pylist()]
    if not pairs.num_rows:
        return pa.table({"doc_a": pairs.column("doc_a"), "doc_b": pairs.column("doc_b"), "n_common": pa.array([], pa.int64()), "n_union": pa.array([], pa.int64())})
    known = np.unique(np.concatenate(marks))
    sets = [np.searchsorted(known, np.unique(m)) for m in marks]
    del marks
    pairs = pairs.sort_by("doc_a")
    held, last = np.zeros(len(known), dtype=bool), None
    common, union = [], []
    for a, b in zip(pairs.column("doc_a").to_pylist(), pairs.column("doc_b").to_pylist()):
        x, y = sets[place[a]], sets[place[b]]
        if a != last:
            held[:] = False
            held[x], last = True, a
        n = int(np.count_nonzero(held[y]))
        common.append(n)
        union.append(len(x) + len(y) - n)
    return pa.table({"doc_a": pairs.column("doc_a"), "doc_b": pairs.column("doc_b"), "n_common": pa.array(common, pa.int64()), "n_union": pa.array(union, pa.int64())})


def exact_similarity(pairs: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_a, doc_b, n_common, n_union: the sizes of the pairs' sets of shingles.

    Pairs are dealt to buckets with the texts that they name, each text once a bucket; sets are made there.
    Near copies have their least partner in common, so pairs of one group mostly meet in one bucket; groups
    of over TOGETHER pairs' texts are dealt as pairs of parts."""
    pairs = written(pairs.select("doc_a", "doc_b"))
    named = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("key"), F.col("doc_a").alias("first"))
    leasts = written(named.groupBy("key").agg(F.min("first").alias("g")))
    sizes = leasts.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
    at = pairs.join(leasts.withColumnRenamed("key", "doc_a"), "doc_a").join(sizes, "g")
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    buckets = max(1, -(-leasts.count() // TOGETHER))
    group = F.xxhash64("g", part("doc_a"), part("doc_b"))
    # A group in parts has buckets of its own; small groups share some.
    at = written(at.select("doc_a", "doc_b", F.when(F.col("parts") > 1, group).otherwise(F.pmod(group, F.lit(buckets))).alias("bucket")))
    asked = at.select(F.col("bucket").alias("own"), F.explode(F.array("doc_a", "doc_b")).alias("key")).distinct()
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).join(asked, "key")
    kind = pairs.schema["doc_a"].dataType.simpleString()
    return at.groupBy("bucket").cogroup(texts.groupBy("own")).applyInArrow(_common, f"doc_a {kind}, doc_b {kind}, n_common long, n_union long")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def contained(fragments: DataFrame, fkey: str, ftext: str, docs: DataFrame, key: str, text: str, size: int = 13) -> DataFrame:
    """fragment, doc, n_shared: how many distinct windows of a fragment a text holds."""
    mine = written(window_hashes(fragments, fkey, ftext, size).select(F.col("key").alias("fragment"), "h1", "h2").distinct())
    # Of the texts only windows that a fragment has go on, each once.
    theirs = window_hashes(docs, key, text, size).select(F.col("key").alias("doc"), "h1", "h2")
    theirs = theirs.join(mine.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").distinct()
    return join_in_parts(mine, written(theirs), ["h1", "h2"]).groupBy("fragment", "doc").agg(F.count(F.lit(1)).alias("n_shared"))


_SYMBOLS = r"[{}\[\]()<>;,:!?=+\-*/%&|^~]+"  # fixed: the runs that confidence compares


def confidence(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with confidence, renamed and literal_differs for the texts of two columns."""
    runs = lambda c, p: F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    of = {n: [runs(c, p) for c in (a, b)] for n, p in (("s", _SYMBOLS), ("i", "[A-Za-z_][A-Za-z0-9_]*"), ("n", "[0-9]+"))}
    rows = [F.size(F.split(F.col(c), "\n")) for c in (a, b)]
    score = F.least(F.lit(0.95), 0.7 * jaccard(*of["s"]) + 0.3 * F.least(*rows) / F.greatest(*rows))
    some = lambda n: (F.size(of[n][0]) > 0) & (F.size(of[n][1]) > 0)
    return df.withColumns({
        "confidence": half_up(score, 2),
        "renamed": some("i") & (jaccard(*of["i"]) < 0.5),
        "literal_differs": some("n") & (jaccard(*of["n"]) < 0.3),
    })


def merged(found: DataFrame, path: str = "path") -> DataFrame:
    """path, start, end, method, confidence, n_merged: overlapping findings of a file as one.
    found: path, start, end, method, confidence."""
    before = Window.partitionBy(path).orderBy("start", "end", "method").rowsBetween(Window.unboundedPreceding, -1)
    own = found.withColumn("new", F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1))
    own = own.withColumn("island", F.sum("new").over(Window.partitionBy(path).orderBy("start", "end", "method")))
    method = F.when(F.min("method") == F.max("method"), F.min("method")).otherwise("both")
    out = own.groupBy(path, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), method.alias("method"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_merged"))
    return out.drop("island")


def plan_risk(items: DataFrame, matches: DataFrame, item: str = "item_id", score: str = "confidence") -> DataFrame:
    """item, n_high, n_middle, best, risk: items without matches have none."""
    high, middle = F.count_if(F.col(score) >= 0.8), F.count_if((F.col(score) >= 0.5) & (F.col(score) < 0.8))
    summed = matches.groupBy(item).agg(high.alias("n_high"), middle.alias("n_middle"), F.max(score).alias("best"))
    out = items.select(item).join(summed, item, "left").fillna(0, ["n_high", "n_middle"])
    h, m = F.col("n_high"), F.col("n_middle")
    risk = F.when((h >= 2) | (F.col("best") >= 0.9), "high").when((h >= 1) | (m >= 2), "medium").when(m >= 1, "low").otherwise("none")
    return out.withColumn("risk", risk)


def suggested_action(risk: Column) -> Column:
    return F.when(risk == "high", "reuse_existing").when(risk == "medium", "refactor_plan").otherwise("proceed")


def blocking_matches(matches: DataFrame, item: str, match: str, score: str = "confidence", most: int = 3) -> DataFrame:
    """item, rank, match, score: the best few matches of each item, ties by name."""
    rank = F.row_number().over(Window.partitionBy(item).orderBy(F.desc(score), match)).cast("long")
    return matches.select(item, match, score).withColumn("rank", rank).where(F.col("rank") <= most)


def step_queries(steps: DataFrame, item: str = "step") -> DataFrame:
    """item, query: what to look for a plan's step by - its key terms, the functions it makes, its action."""
    own = F.concat(F.coalesce("key_terms", F.array().cast("array<string>")), F.coalesce("functions_to_create", F.array().cast("array<string>")), F.array("action"))
    return steps.select(item, F.array_join(F.filter(own, lambda x: x != ""), " ").alias("query"))


def analyse_plan(steps: DataFrame, corpus: DataFrame, item: str = "step", least: float = 0.3, most: int = 5) -> DataFrame:
    """item, query, n_high, n_middle, best, risk, action, matches (the best three files with their scores).

    A file answers a step by the share of the query's distinct words that it has; at least ``least`` of
    them, and of each step its ``most`` best files count."""
    asked = written(step_queries(steps, item))
    terms = asked.select(item, F.explode(F.array_distinct(F.expr("regexp_extract_all(lower(query), '[a-z_][a-z0-9_]*', 0)"))).alias("term"))
    n = terms.groupBy(item).agg(F.count(F.lit(1)).alias("n_terms"))
    files = corpus.select(F.concat_ws("/", "repository", "path").alias("file"), F.explode(F.array_distinct(F.expr("regexp_extract_all(lower(content), '[a-z_][a-z0-9_]*', 0)"))).alias("term"))
    hits = files.join(terms, "term").groupBy(item, "file").agg(F.count(F.lit(1)).alias("n"))
    scored = hits.join(n, item).select(item, "file", half_up(F.col("n") / F.col("n_terms"), 2).alias("confidence")).where(F.col("confidence") >= least)
    scored = written(blocking_matches(scored, item, "file", most=most).drop("rank"))
    best = blocking_matches(scored, item, "file").groupBy(item).agg(F.array_sort(F.collect_list(F.struct("rank", "file", "confidence"))).alias("matches"))
    out = asked.join(plan_risk(asked, scored, item), item).join(best, item, "left").withColumn("action", suggested_action(F.col("risk")))
    return out.select(item, "query", "n_high", "n_middle", "best", "risk", "action", "matches")


def overall_risk(risks: DataFrame) -> DataFrame:
    n, high, middle = F.count(F.lit(1)), F.count_if(F.col("risk") == "high"), F.count_if(F.col("risk") == "medium")
    out = risks.agg(n.alias("n_steps"), high.alias("n_high"), middle.alias("n_medium"))
    risk = F.when((F.col("n_high") > 0) & (F.col("n_high") >= F.col("n_steps") / 2), "high").when((F.col("n_high") > 0) | ((F.col("n_medium") > 0) & (F.col("n_medium") >= F.col("n_steps") / 3)), "medium").otherwise("low")
    return out.withColumn("risk", risk)


def search(df: DataFrame, key: str, text: str, terms: list[str], k: int = 20) -> DataFrame:
    """key, score, rank: the k best texts for the terms by term frequency and rarity.  A text's words
    are counted where they are, so only counts of texts with a hit are shuffled."""
    own = df.select(F.col(key).alias("key"), words(F.lower(F.col(text))).alias("w"))
    hits = own.select("key", F.size("w").alias("n"), F.explode(_term_counts(terms)).alias("c")).select("key", "n", "c.term", "c.tf").where("tf > 0")
    total = own.agg(F.count(F.lit(1)).alias("docs"))
    rarity = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarity = _rarity(rarity, total)  # a row for each term
    scored = hits.join(F.broadcast(rarity), "term").groupBy("key").agg(half_up(F.sum(F.col("tf") / F.col("n") * F.col("idf")), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), "key").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")).cast("long"))


def _term_counts(terms: list[str]) -> Column:
    one = lambda t: F.struct(F.lit(t).alias("term"), F.size(F.filter("w", lambda x: x == F.lit(t))).cast("long").alias("tf"))
    return F.array(*map(one, terms))


def _rarity(counts: DataFrame, total: DataFrame) -> DataFrame:
    n = float(total.first()[0])
    return counts.select("term", F.log(1.0 + n / F.col("df")).alias("idf"))
