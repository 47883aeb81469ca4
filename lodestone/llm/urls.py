"""Operator 4: URL filter by the ratio of two character language models.

Rules over hosts and path prefixes decide first.  URLs that rules allow or block train one smoothed
variable-order Markov model each, over all characters of the whole URL: the probability of a character
after the ORDER - 1 characters before it backs off to that after one character less, and so on down to
that of the character alone, by as much as the longer context is rare.  A URL that no rule decides is
allowed if its log-likelihood difference for each character reaches a threshold, which is calibrated on
rule-decided URLs of hosts that the models did not see: where two normal curves through the scores of
allowed and blocked URLs weigh the same.

All steps are DataFrame operations.  The models are tables of the character sequences that the URLs
hold, counted over all of them, so they grow with the data.  A position of a URL needs one lookup, by
its window of ORDER characters: the models' difference is worked out once for each distinct window,
level by level, from the window's own suffixes.  All joins are merge joins of shuffled rows, as both of
their sides grow with the data: Spark takes a table's size on disk for its size in memory, and would send
through the driver what is many times larger there.

Defined cases: a URL that is null or has no ``://`` has an empty host and path, and a null one counts as
empty text; without both allowed and blocked URLs all scores and the threshold are 0, and what no rule
decides is allowed; a URL that a rule decides has a score only if the calibration needs it, else null;
repeated rows are judged each; long URLs are taken whole, in linear time; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table, written

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Characters of a window: the one that is rated and its longest context.
ORDER = 6
#: Counts that the shorter context's estimate stands for.
BACKOFF = 2.0
#: Signs before and after a URL.
START, END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    found, verdict = [], []
    for what, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.lit(rule)))
        verdict.append(F.when(fits, F.lit(what)))
    return F.coalesce(*found, F.lit(None).cast("string")), F.coalesce(*verdict, F.lit(None).cast("string"))


def _unseen(host: Column) -> Column:
    """Whether a host is kept for the calibration: a quarter of them, by hash."""
    return F.substring(F.md5(host.cast("binary")), 1, 1).isin("0", "4", "8", "c")


def windows(urls: DataFrame) -> DataFrame:
    """row, ruled, unseen, window: for each character but the start sign, it and up to ORDER - 1 before it.

    chars must be a column of a table, not an expression: within the lambda it would be evaluated again
    at every position."""
    one = lambda i: F.array_join(F.slice("chars", F.greatest(i - (ORDER - 1), F.lit(1)), F.least(i, F.lit(ORDER))), "")
    return urls.select("row", "ruled", "unseen", F.explode(F.transform(F.sequence(F.lit(2), F.size("chars")), one)).alias("window"))


def model(each: DataFrame) -> DataFrame:
    """window, ratio: the log of how much likelier the last character is, after the others, among
    accepted URLs than among rejected ones.  each: windows of the URLs to learn from (ruled, of seen
    hosts) and of those to score, which count for nothing but get a row."""
    seen = F.col("ruled").isNotNull() & ~F.col("unseen")
    counted = each.groupBy("window").agg(F.count_if(seen & (F.col("ruled") == "allow")).alias("a"), F.count_if(seen & (F.col("ruled") == "block")).alias("b"))
    grams = counted.select(F.explode(F.sequence(F.lit(1), F.length("window"))).alias("k"), "window", "a", "b")
    grams = written(grams.groupBy("k", F.expr("right(window, k)").alias("gram")).agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b")))
    single = grams.where("k = 1")
    signs, *whole = single.agg(F.count(F.lit(1)), F.coalesce(F.sum("a"), F.lit(0.0)), F.coalesce(F.sum("b"), F.lit(0.0))).first()
    share = lambda c, n: ((F.col(c) + 1) / F.lit(float(n + signs))).alias(c)
    level = written(single.select("gram", share("a", whole[0]), share("b", whole[1]))) if signs else single.select("gram", "a", "b")
    out = None
    for k in range(2, ORDER + 1):
        own = grams.where(F.col("k") == k).withColumns({"before": F.expr("left(gram, k - 1)"), "shorter": F.expr("right(gram, k - 1)")})
        context = own.groupBy("before").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
        less = level.select(F.col("gram").alias("shorter"), F.col("a").alias("less_a"), F.col("b").alias("less_b"))
        smooth = lambda c: ((F.col(c) + F.col(f"less_{c}") * BACKOFF) / (F.col(f"all_{c}") + BACKOFF)).alias(c)
        level = written(own.join(context.hint("merge"), "before").join(less.hint("merge"), "shorter").select("gram", smooth("a"), smooth("b")))
        # Shorter windows than ORDER are those at the start.
        some = level if k == ORDER else level.where(F.col("gram").startswith(START))
        out = some if out is None else out.unionByName(some)
    ratio = F.log("a") - F.log("b") if whole[0] > 0 and whole[1] > 0 else F.lit(0.0)
    return out.select(F.col("gram").alias("window"), ratio.alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """scored: ruled, score of the rule-decided URLs of hosts that the models did not see."""
    found = {r.ruled: r for r in scored.groupBy("ruled").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd")).collect()}
    if len(found) < 2:
        return 0.0
    a, b = found["allow"], found["block"]
    spread = a.sd + b.sd
    return float((a.mean * b.sd + b.mean * a.sd) / spread) if spread > 0 else float((a.mean + b.mean) / 2)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """key, host, path, rule, verdict, score."""
    host, path = host_and_path(pages[url])
    text = F.concat(F.lit(START), F.translate(F.coalesce(pages[url], F.lit("")), _UPPER, _LOWER), F.lit(END))
    own = pages.select(pages[key].alias("key"), host.alias("host"), path.alias("path"), F.split(text, "").alias("chars"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    own = written(own.withColumns({"rule": rule, "ruled": ruled, "unseen": _unseen(F.col("host")), "row": F.monotonically_increasing_id()}))
    each = windows(own)
    asked = F.col("ruled").isNull() | F.col("unseen")
    met = each.where(asked).select("row", "window").join(model(each).hint("merge"), "window")
    scores = written(met.groupBy("row").agg(F.avg("ratio").alias("score")))
    judged = own.drop("chars").join(scores.hint("merge"), "row", "left")
    limit = threshold(judged.where("ruled IS NOT NULL AND unseen"))
    verdict = F.coalesce("ruled", F.when(F.round("score", 9) >= round(limit, 9), "allow").otherwise("block"))
    return judged.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    whens = [(what, rule, *rule.partition("/")) for what, rule in sorted(RULES, key=lambda r: -len(r[1]))]
    fits = [(what, rule, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{s + rest}')") for what, rule, h, s, rest in whens]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[i]}'" for f in fits) + " END"
    back = f"{BACKOFF}::DOUBLE"
    levels = ["l1 AS (SELECT gram, (a + 1) / (sum(a) OVER () + count(*) OVER ()) AS a, (b + 1) / (sum(b) OVER () + count(*) OVER ()) AS b FROM grams WHERE k = 1)"]
    for k in range(2, ORDER + 1):
        levels.append(f"""l{k} AS (
      SELECT g.gram, (g.a + l.a * {back}) / (all_a + {back}) AS a, (g.b + l.b * {back}) / (all_b + {back}) AS b
      FROM (SELECT *, sum(a) OVER (PARTITION BY left(gram, {k - 1})) AS all_a, sum(b) OVER (PARTITION BY left(gram, {k - 1})) AS all_b FROM grams WHERE k = {k}) g
      JOIN l{k - 1} l ON l.gram = right(g.gram, {k - 1}))""")
    every = " UNION ALL ".join(f"SELECT * FROM l{k}" + f" WHERE starts_with(gram, chr({ord(START)}))" * (k < ORDER) for k in range(2, ORDER + 1))
    return f"""
    WITH cut AS (
      SELECT page_id, chr({ord(START)}) || translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') || chr({ord(END)}) AS t,
             CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    parts AS (
      SELECT page_id, t, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
    urls AS (
      SELECT row_number() OVER () AS r, page_id, t, host, path, {case(1)} AS rule, {case(0)} AS ruled,
             substr(md5(host), 1, 1) IN ('0', '4', '8', 'c') AS unseen FROM parts),
    each AS (
      SELECT r, ruled, unseen, substr(t, greatest(i - {ORDER - 1}, 1), least(i, {ORDER})) AS w
      FROM (SELECT *, unnest(range(2, length(t) + 1)) AS i FROM urls)),
    counted AS (
      SELECT w, count(*) FILTER (ruled = 'allow' AND NOT unseen) AS a, count(*) FILTER (ruled = 'block' AND NOT unseen) AS b
      FROM each GROUP BY w),
    grams AS (
      SELECT k, right(w, k) AS gram, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b
      FROM (SELECT *, unnest(range(1, length(w) + 1)) AS k FROM counted) GROUP BY ALL),
    {", ".join(levels)},
    whole AS (SELECT sum(a) AS n_a, sum(b) AS n_b FROM grams WHERE k = 1),
    ratios AS (SELECT gram, CASE WHEN n_a > 0 AND n_b > 0 THEN ln(a) - ln(b) ELSE 0 END AS ratio FROM ({every}), whole),
    scores AS (SELECT r, avg(ratio) AS score FROM each JOIN ratios ON w = gram WHERE ruled IS NULL OR unseen GROUP BY r),
    scored AS (SELECT urls.*, score FROM urls LEFT JOIN scores USING (r)),
    held AS (
      SELECT avg(score) FILTER (ruled = 'allow') AS ma, avg(score) FILTER (ruled = 'block') AS mb,
             stddev_pop(score) FILTER (ruled = 'allow') AS sa, stddev_pop(score) FILTER (ruled = 'block') AS sb
      FROM scored WHERE ruled IS NOT NULL AND unseen),
    lim AS (
      SELECT coalesce(CASE WHEN sa + sb > 0 THEN (ma * sb + mb * sa) / (sa + sb) ELSE (ma + mb) / 2 END, 0) AS bound FROM held)
    SELECT page_id, host, path, rule,
           coalesce(ruled, CASE WHEN round(score, 9) >= round(bound, 9) THEN 'allow' ELSE 'block' END) AS verdict
    FROM scored, lim
    """


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {"op4_url_filter": _oracle}
