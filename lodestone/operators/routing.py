"""Effort estimates of texts: plan score, keyword estimate, tiers, blocks and subtasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import by_tier, half_up, lines, tier, words

# The words that the estimate counts.
SIMPLE = "refactor rename add update small fix bug typo minor cosmetic tweak bump upgrade".split()
COMPLEX = [
    *"architect design implement create system multiple cross-cutting pipeline migrate distributed orchestrate infrastructure".split(),
    *"platform framework scalable enterprise comprehensive multi-service".split(), "refactor across", "end-to-end",
]
TOKENS = {"simple": 500, "medium": 4000, "complex": 32000}
LEVEL_SCORE = {"simple": 10, "medium": 28, "complex": 60}


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def plan_score(text: Column) -> Column:
    """Points for length, headings, code blocks and bullets, rounded to a tenth."""
    n = word_count(text)
    headings = F.regexp_count(text, F.lit(r"(?m)^#{1,6} "))
    fences = F.regexp_count(text, F.lit("```"))
    bullets = F.regexp_count(text, F.lit(r"(?m)^[ \t]*(?:[-*+]|[0-9]+[.)]) "))
    parts = (F.least(F.lit(40.0), n / 20), F.least(F.lit(30.0), 5.0 * headings), F.least(F.lit(20.0), 5.0 * F.floor(fences / 2)), F.least(F.lit(10.0), 2.0 * bullets))
    return half_up(sum(parts[1:], parts[0]), 1)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many of the words occur, also inside of others."""
    low = F.lower(text)
    hits = [F.when(low.contains(k), 1).otherwise(0) for k in keywords]
    return sum(hits[1:], hits[0]).cast("long")


def estimate(df: DataFrame, text: str) -> DataFrame:
    """df with level, confidence, simple_hits, complex_hits, estimated_tokens and score."""
    s, c, n = keyword_hits(F.col(text), SIMPLE), keyword_hits(F.col(text), COMPLEX), word_count(F.col(text))
    out = df.withColumns({"simple_hits": s, "complex_hits": c, "n_words": n})
    hard, easy = (F.col("complex_hits") > F.col("simple_hits")) & (F.col("complex_hits") >= 2), (F.col("simple_hits") > F.col("complex_hits")) & (F.col("simple_hits") >= 2)
    level = F.when(hard, "complex").when(easy, "simple").when(F.col("n_words") < 50, "simple").when(F.col("n_words") <= 200, "medium").otherwise("complex")
    sure = F.when(hard, F.least(F.lit(0.95), 0.5 + 0.1 * F.col("complex_hits"))).when(easy, F.least(F.lit(0.9), 0.5 + 0.1 * F.col("simple_hits"))).otherwise(F.lit(0.6))
    out = out.withColumns({"level": level, "confidence": half_up(sure, 4)})
    pick = lambda of: F.when(F.col("level") == "simple", of["simple"]).when(F.col("level") == "medium", of["medium"]).otherwise(of["complex"])
    return out.withColumns({"estimated_tokens": pick(TOKENS).cast("long"), "score": pick(LEVEL_SCORE).cast("double")})


def route(df: DataFrame, score: str = "score") -> DataFrame:
    return df.withColumns({"tier": tier(F.col(score)), "tier_name": by_tier(F.col(score), 2), "effort": by_tier(F.col(score), 3)})


def tier_breakdown(scored: DataFrame, score: str = "score") -> DataFrame:
    out = route(scored, score).groupBy("tier")
    # Whole tenths are summed, so that the mean doesn't depend on the order.
    return out.agg(F.count(F.lit(1)).alias("n"), half_up(F.sum(F.round(F.col(score) * 10).cast("long")) / 10.0 / F.count(F.lit(1)), 4).alias("mean_score"))


def subtasks(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, ordinal, title: list items; without any, the parts between "and then" or "followed by",
    and sentences, of more than five characters."""
    item = r"(?m)^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+(.+)$"
    items = F.regexp_extract_all(text, F.lit(item), F.lit(1))
    parts = F.transform(F.split(F.col(text), r"(?i) and then | followed by |[.!?](?:[ \n]|\z)"), lambda p: F.trim(F.regexp_replace(p, r"[ \t\n\r\f]+", " ")))
    titles = F.when(F.size(items) > 0, F.transform(items, lambda p: F.trim(p))).otherwise(F.filter(parts, lambda p: F.length(p) > 5))
    return df.select(*keys, F.posexplode(titles).alias("p", "title")).select(*keys, (F.col("p") + 1).cast("long").alias("ordinal"), "title")


def blocks(df: DataFrame, keys: list[str], order: str, opens: Column, text: str) -> DataFrame:
    """keys, block, n_rows, text: a row that ``opens`` begins a block, rows before the first make block 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    own = df.withColumn("block", F.sum(F.when(opens, 1).otherwise(0)).over(w).cast("long"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return own.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n_rows"), joined.alias("text"))


def plan_blocks(plans: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of a written plan: a heading opens one, so does a list item outside any heading."""
    each = lines(plans.select(key, text), text)
    heading = F.col("line").rlike(r"^#{1,6} ")
    under = F.max(F.when(heading, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    opens = heading | (F.col("line").rlike(r"^[ \t]*(?:[-*+]|[0-9]+[.)]) ") & (F.col("u") == 0))
    return blocks(each.withColumn("u", under), [key], "line_no", opens, "line")
