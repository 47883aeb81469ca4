"""Token estimates, reductions, effort estimates and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import fnv1a, lines, token_estimate
from lodestone.operators import rewrite, routing
from lodestone.plans.common import CORPUS, LINES, corpus, table

USER = "(SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"


def _user(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def token_estimates(spark, d):
    each = corpus(spark, d).select("lang", token_estimate(F.col("content")).alias("t"))
    return each.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("t").cast("long").alias("tokens"), F.max("t").alias("most"))


def squeeze_pages(spark, d):
    return rewrite.squeeze_markup(table(spark, d, "pages"), "html", ["page_id"])


def plan_score(spark, d):
    return _user(spark, d).select("conv_id", "turn", routing.plan_score(F.col("text")).alias("score"))


def estimate_complexity(spark, d):
    return routing.estimate(_user(spark, d), "text").drop("text")


def route_tier(spark, d):
    return routing.route(plan_score(spark, d))


def effort_estimate(spark, d):
    return routing.route(routing.estimate(_user(spark, d), "text")).select("conv_id", "turn", "level", "tier", "effort")


def tier_breakdown(spark, d):
    docs = corpus(spark, d).select(routing.plan_score(F.col("content")).alias("score"))
    return routing.tier_breakdown(docs)


def subtasks(spark, d):
    return routing.subtasks(_user(spark, d), "text", ["conv_id", "turn"])


def plan_blocks(spark, d):
    return routing.blocks(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "user", "text")


def document_plan(spark, d):
    """Documents as written plans: their blocks, each with its score and tier."""
    blocks = routing.plan_blocks(corpus(spark, d), "path", "content")
    return routing.route(blocks.select("path", "block", "n_rows", routing.plan_score(F.col("text")).alias("score"))).drop("tier_name", "effort")


def name_hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", fnv1a(F.col("p_name")).alias("hash"))


def refactor_batch(spark, d):
    """Two words renamed and one replaced over all documents: the changed ones, with their new hash."""
    before = corpus(spark, d)
    ops = [rewrite.Operation("rename", old="the", new="ZZZ"), rewrite.Operation("replace", old="ZZZ of", new="YYY")]
    after = rewrite.refactor(before, ops)
    # Both sides come from the same rows: the old hash rides along instead of a join.
    both = before.withColumn("old", F.md5(F.col("content").cast("binary")))
    both = rewrite.refactor(both, ops).withColumn("new", F.md5(F.col("content").cast("binary")))
    assert after.columns == before.columns
    return both.where("old <> new").select("path", "new")


def line_diff(spark, d):
    """Lines that the rewriting changes, by repository."""
    before = corpus(spark, d)
    after = before.withColumn("content", F.regexp_replace("content", "thth", "TH"))
    of = lambda c: lines(c.select("repository", "content"), "content").select("repository", "line")
    return rewrite.diff(of(before), of(after), ["repository"])


QUERIES = {f.__name__: f for f in (token_estimates, squeeze_pages, plan_score, estimate_complexity, route_tier, effort_estimate, tier_breakdown, subtasks, plan_blocks, document_plan, name_hashes, refactor_batch, line_diff)}

_WORDS = r"len(list_filter(string_split_regex({t}, '[ \t\n\r\f]+'), lambda w: w <> ''))"
_UP = lambda x, s: f"floor(({x}) * {s}::DOUBLE + 0.5::DOUBLE) / {s}::DOUBLE"


def _score(t: str) -> str:
    n = lambda p: f"len(regexp_extract_all({t}, '{p}'))"
    parts = f"least(40::DOUBLE, {_WORDS.format(t=t)} / 20::DOUBLE) + least(30::DOUBLE, 5::DOUBLE * {n('(?m)^#{1,6} ')})"
    parts += f" + least(20::DOUBLE, 5::DOUBLE * floor({n('```')} / 2::DOUBLE)) + least(10::DOUBLE, 2::DOUBLE * {n(r'(?m)^[ \t]*(?:[-*+]|[0-9]+[.)]) ')})"
    return _UP(parts, 10)


_TIER = "CASE WHEN score <= 15 THEN 1 WHEN score <= 40 THEN 2 WHEN score <= 80 THEN 3 ELSE 4 END::BIGINT"
_NAME = "CASE WHEN score <= 15 THEN 'junior' WHEN score <= 40 THEN 'mid' WHEN score <= 80 THEN 'senior' ELSE 'expert' END"
_EFFORT = "CASE WHEN score <= 15 THEN 'trivial' WHEN score <= 40 THEN 'moderate' WHEN score <= 80 THEN 'complex' ELSE 'expert' END"
_HITS = lambda ks: " + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN 1 ELSE 0 END" for k in ks)
_ESTIMATE = f"""e0 AS (SELECT conv_id, turn, ({_HITS(routing.SIMPLE)})::BIGINT AS simple_hits, ({_HITS(routing.COMPLEX)})::BIGINT AS complex_hits, {_WORDS.format(t='text')}::BIGINT AS n_words FROM {USER}),
  e1 AS (SELECT *, complex_hits > simple_hits AND complex_hits >= 2 AS hard, simple_hits > complex_hits AND simple_hits >= 2 AS easy FROM e0),
  e2 AS (SELECT conv_id, turn, simple_hits, complex_hits, n_words,
    CASE WHEN hard THEN 'complex' WHEN easy THEN 'simple' WHEN n_words < 50 THEN 'simple' WHEN n_words <= 200 THEN 'medium' ELSE 'complex' END AS level,
    {_UP("CASE WHEN hard THEN least(0.95::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * complex_hits) WHEN easy THEN least(0.9::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * simple_hits) ELSE 0.6::DOUBLE END", 10000)} AS confidence FROM e1),
  e AS (SELECT *, CASE level WHEN 'simple' THEN 500 WHEN 'medium' THEN 4000 ELSE 32000 END::BIGINT AS estimated_tokens,
    CASE level WHEN 'simple' THEN 10 WHEN 'medium' THEN 28 ELSE 60 END::DOUBLE AS score FROM e2)"""
_MARKUP = "html"
for _p, _n in rewrite.MARKUP:
    _MARKUP = f"regexp_replace({_MARKUP}, '{_p}', '{_n}', 'g')"
_ITEM = r"(?m)^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+(.+)$"

#: Twice, as neighbours share the character between them.
_THE = r"(^|[^A-Za-z0-9_$])the([^A-Za-z0-9_$]|\z)"

ORACLES = {
    "token_estimates": "SELECT lang, count(*) AS n_docs, sum(ceil(length(text) / 4::DOUBLE)::BIGINT)::BIGINT AS tokens, max(ceil(length(text) / 4::DOUBLE)::BIGINT) AS most FROM documents GROUP BY 1",
    "squeeze_pages": f"""WITH s AS (SELECT page_id, ceil(length(html) / 4::DOUBLE)::BIGINT AS tokens_before, trim({_MARKUP}) AS squeezed FROM pages),
      t AS (SELECT *, ceil(length(squeezed) / 4::DOUBLE)::BIGINT AS tokens_after FROM s)
      SELECT *, CASE WHEN tokens_before > 0 THEN {_UP("1 - tokens_after / tokens_before::DOUBLE", 10000)} ELSE 0::DOUBLE END AS reduction FROM t""",
    "plan_score": f"SELECT conv_id, turn, {_score('text')} AS score FROM {USER}",
    "estimate_complexity": f"WITH {_ESTIMATE} SELECT * FROM e",
    "route_tier": f"WITH s AS (SELECT conv_id, turn, {_score('text')} AS score FROM {USER}) SELECT *, {_TIER} AS tier, {_NAME} AS tier_name, {_EFFORT} AS effort FROM s",
    "effort_estimate": f"WITH {_ESTIMATE} SELECT conv_id, turn, level, {_TIER} AS tier, {_EFFORT} AS effort FROM e",
    "tier_breakdown": f"""WITH s AS (SELECT {_score('text')} AS score FROM documents)
      SELECT {_TIER} AS tier, count(*) AS n, {_UP("sum(round(score * 10)::BIGINT) / 10::DOUBLE / count(*)", 10000)} AS mean_score FROM s GROUP BY 1""",
    "subtasks": rf"""WITH i AS (SELECT conv_id, turn, regexp_extract_all(text, '{_ITEM}', 1) AS items,
        list_transform(string_split_regex(text, '(?i) and then | followed by |[.!?](?:[ \n]|\z)'), lambda p: trim(regexp_replace(p, '[ \t\n\r\f]+', ' ', 'g'))) AS parts FROM {USER}),
      t AS (SELECT conv_id, turn, CASE WHEN len(items) > 0 THEN list_transform(items, lambda p: trim(p)) ELSE list_filter(parts, lambda p: length(p) > 5) END AS titles FROM i)
      SELECT conv_id, turn, o::BIGINT AS ordinal, titles[o] AS title FROM t, unnest(range(1, len(titles) + 1)) AS u(o)""",
    "document_plan": rf"""WITH {CORPUS}, {LINES},
      h AS (SELECT *, regexp_matches(line, '^#{{1,6}} ') AS head, regexp_matches(line, '^[ \t]*(?:[-*+]|[0-9]+[.)]) ') AS item FROM lines),
      u AS (SELECT *, max(head::INT) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS u FROM h),
      b AS (SELECT path, line_no, line, sum((head OR (item AND u = 0))::INT) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM u),
      g AS (SELECT path, block, count(*) AS n_rows, string_agg(line, chr(10) ORDER BY line_no) AS text FROM b GROUP BY 1, 2),
      s AS (SELECT path, block, n_rows, {_score('text')} AS score FROM g) SELECT *, {_TIER} AS tier FROM s""",
    "name_hashes": """SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(p_name) + 1), lambda i: unicode(substr(p_name, i, 1))::BIGINT)),
      lambda h, c: xor(h, c) * 16777619 % 4294967296) AS hash FROM part""",
    "plan_blocks": r"""WITH b AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS block FROM conversations)
      SELECT conv_id, block, count(*) AS n_rows, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM b GROUP BY 1, 2""",
    "refactor_batch": rf"""WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS path, text, regexp_replace(regexp_replace(text, '{_THE}', '\1ZZZ\2', 'g'), '{_THE}', '\1ZZZ\2', 'g') AS t FROM documents)
      SELECT path, md5(replace(t, 'ZZZ of', 'YYY')) AS new FROM r WHERE replace(t, 'ZZZ of', 'YYY') <> text""",
    "line_diff": rf"""WITH {CORPUS}, {LINES}, c2 AS (SELECT repository, path, lang, regexp_replace(content, 'thth', 'TH', 'g') AS content FROM corpus),
      l2 AS (SELECT repository, l[i] AS line FROM (SELECT repository, string_split_regex(content, '\r?\n') AS l FROM c2), unnest(range(1, len(l) + 1)) AS t(i)),
      d AS (SELECT repository, line, sum(s) AS d FROM (SELECT repository, line, -1 AS s FROM lines UNION ALL SELECT repository, line, 1 FROM l2) GROUP BY 1, 2)
      SELECT repository, line, CASE WHEN d > 0 THEN '+' ELSE '-' END AS change, abs(d)::BIGINT AS n FROM d WHERE d <> 0""",
}
