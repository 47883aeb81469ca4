"""Clone detection and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import lines
from lodestone.operators import clones, sequences
from lodestone.operators.rules import TEXT_RULES, count_matches
from lodestone.plans.common import CORPUS, LINES, corpus, table
from lodestone.plans.scanning import _ALL
from lodestone.tables import spread, written


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def exact_duplicates(spark, d):
    return clones.exact_groups(_docs(spark, d), "doc_id", "text")


def clone_members(spark, d):
    """Every document with the one that stands for it in the queries over distinct texts."""
    return clones.members(_docs(spark, d), "doc_id", "text").withColumnRenamed("key", "doc_id")


def token_windows(spark, d):
    """How many 30-word windows are shared by how many distinct texts."""
    return clones.shared_windows(_docs(spark, d), "doc_id", "text")


def clone_pairs(spark, d):
    return clones.token_clones(_docs(spark, d), "doc_id", "text")


def longest_clones(spark, d):
    return clones.token_clones(_docs(spark, d), "doc_id", "text", longest=True).select("doc_a", "doc_b", "n_tokens", F.least(F.lit(1.0), 0.5 + F.col("n_tokens") / 500 * 0.5).alias("confidence"))


def skeleton_groups(spark, d):
    return clones.skeleton_groups(_docs(spark, d), "doc_id", "text")


def minhash_signatures(spark, d):
    return clones.signatures(_docs(spark, d), "doc_id", "text").select(F.col("key").alias("doc_id"), F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


def lsh_pairs(spark, d):
    return clones.lsh_pairs(written(clones.signatures(clones.distinct_texts(_docs(spark, d), "doc_id", "text"), "key", "text")))


def jaccard_pairs(spark, d):
    """The pairs of lsh_pairs with their exact similarity."""
    return clones.exact_similarity(lsh_pairs(spark, d), _docs(spark, d), "doc_id", "text")


def fragment_search(spark, d):
    found = clones.contained(table(spark, d, "benchmark"), "item_id", "text", _docs(spark, d), "doc_id", "text")
    return found.select(F.col("fragment").alias("item_id"), F.col("doc").alias("doc_id"), "n_shared")


def clone_confidence(spark, d):
    both = fragment_search(spark, d).join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("a")), "item_id").join(_docs(spark, d).withColumnRenamed("text", "b"), "doc_id")
    return clones.confidence(both, "a", "b").select("item_id", "doc_id", "confidence", "renamed", "literal_differs")


def merged_findings(spark, d):
    found = count_matches(corpus(spark, d), TEXT_RULES)
    spans = found.select("path", F.col("line_no").alias("start"), (F.col("line_no") + 2).alias("end"), F.col("rule_id").alias("method"), F.least(F.lit(1.0), 0.5 + F.col("n") / 10).alias("confidence"))
    return clones.merged(spans)


def _matches(spark, d):
    return fragment_search(spark, d).select("item_id", F.least(F.lit(1.0), 0.4 + F.col("n_shared") / 40).alias("confidence"))


def plan_risk(spark, d):
    return clones.plan_risk(table(spark, d, "benchmark"), _matches(spark, d))


def overall_risk(spark, d):
    return clones.overall_risk(plan_risk(spark, d))


def text_search(spark, d):
    return clones.search(_docs(spark, d), "doc_id", "text", ["token", "licensed", "and"], 20)


def symbol_usages(spark, d):
    """Lines that hold the word "license" or "token", once for each word."""
    each = lines(corpus(spark, d).select("path", "content"), "content")
    hits = [each.where(F.col("line").rlike(f"(^|[^A-Za-z0-9_]){s}([^A-Za-z0-9_]|\\z)")).select("path", "line_no", F.lit(s).alias("symbol")) for s in ("license", "token")]
    return hits[0].unionByName(hits[1])


def _events(spark, d):
    return table(spark, d, "events")


def error_islands(spark, d):
    return sequences.islands(_events(spark, d).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 3, 2)


def carry_scope(spark, d):
    own = _events(spark, d).select("event_id", "user_id", "ts", "event_type")
    out = sequences.carried(own, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "signup_id")
    return out.select("event_id", "signup_id")


def running_balance(spark, d):
    change = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)
    return sequences.clamped_depth(_events(spark, d).select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], change).select("event_id", "depth")


def event_props(spark, d):
    own = _events(spark, d).select("event_type", F.from_json("props", "k INT").alias("p"))
    return own.groupBy("event_type").agg(F.sum("p.k").cast("long").alias("sum_k"), F.max("p.k").cast("long").alias("max_k"), F.count("p.k").alias("n"))


def tumbling(spark, d):
    return sequences.tumbling(_events(spark, d), "ts", "1 hour", "event_type")


def sliding(spark, d):
    return sequences.sliding(_events(spark, d), "ts", "1 hour", "30 minutes", "event_type")


def session(spark, d):
    return sequences.sessions(_events(spark, d), "ts", "30 minutes", "user_id")


def vector_topk(spark, d):
    """The five nearest of all vectors to the one of vec_id 0, by cosine rounded to 6 digits."""
    own = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = own.where("vec_id = 0").first()
    if q is None:
        return own.select("vec_id", F.lit(0.0).alias("similarity")).limit(0)
    query = F.array(*map(F.lit, q.v))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot(F.col("v"), query) / (F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(query, query)))
    return own.where("vec_id <> 0").select("vec_id", (F.floor(cosine * 1e6 + 0.5) / 1e6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(5)


_F = [exact_duplicates, clone_members, token_windows, clone_pairs, longest_clones, skeleton_groups, minhash_signatures, lsh_pairs, jaccard_pairs, fragment_search, clone_confidence, merged_findings]
_F += [plan_risk, overall_risk, text_search, symbol_usages, error_islands, carry_scope, running_balance, event_props, tumbling, sliding, session, vector_topk]
QUERIES = {f.__name__: f for f in _F}

_WS = "[ \\t\\n\\r\\f]+"
_W = lambda t: f"list_filter(string_split_regex({t}, '{_WS}'), lambda w: w <> '')"
_DISTINCT = "dt AS (SELECT text, min(doc_id) AS key FROM documents WHERE text IS NOT NULL GROUP BY text)"


def _windows(name: str, source: str, key: str, text: str, size: int) -> str:
    return f"""{name} AS (SELECT k, (i - 1)::BIGINT AS pos, md5(array_to_string(w[i:i + {size - 1}], ' ')) AS h
      FROM (SELECT {key} AS k, {_W(f'lower({text})')} AS w FROM {source}), unnest(range(1, len(w) - {size - 2})) AS t(i) WHERE len(w) >= {size})"""


_SHARED = f"WITH {_DISTINCT}, {_windows('win', 'dt', 'key', 'text', 30)}"
_CLONES = f"""{_SHARED}, met AS (SELECT a.k AS doc_a, b.k AS doc_b, a.pos AS pos_a, b.pos AS pos_b FROM win a JOIN win b ON a.h = b.h AND a.k < b.k),
  nth AS (SELECT *, pos_a - row_number() OVER (PARTITION BY doc_a, doc_b, pos_a - pos_b ORDER BY pos_a) AS run FROM met),
  clones AS (SELECT doc_a, doc_b, min(pos_a) AS start_a, min(pos_b) AS start_b, count(*) + 29 AS n_tokens FROM nth GROUP BY doc_a, doc_b, pos_a - pos_b, run)"""
_NORM = lambda t: f"trim(regexp_replace({t}, '{_WS}', ' ', 'g'))"
_SETS = lambda src, key: f"sh AS (SELECT {key} AS key, list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) AS s FROM (SELECT {key}, {_NORM('text')} AS t FROM {src}) WHERE length(t) >= 5)"
#: A shingle's code points as the digits of a number, modulo the prime.
_NUMBER = "0::BIGINT"
for _i in range(clones.SHINGLE):
    _NUMBER = f"(({_NUMBER} * {clones.BASE} + unicode(x[{_i + 1}])) % {clones.PRIME})"
_SIGS = lambda src, key: f"""{_SETS(src, key)}, hs AS (SELECT key, list_transform(s, lambda x: {_NUMBER}) AS h FROM sh),
  sg AS (SELECT key, [{', '.join(f'list_min(list_transform(h, lambda x: ({a}::BIGINT * x + {b}::BIGINT) % {clones.PRIME}::BIGINT))' for a, b in clones.COEFFICIENTS)}] AS g FROM hs)"""  # noqa: E731
_LSH = f"""WITH {_DISTINCT}, {_SIGS('dt', 'key')}, bands AS (SELECT key, b AS band, array_to_string(g[b * 8 + 1:b * 8 + 8], ',') AS v FROM sg, unnest(range(16)) AS t(b)),
  cand AS (SELECT DISTINCT a.key AS doc_a, b.key AS doc_b FROM bands a JOIN bands b ON a.band = b.band AND a.v = b.v AND a.key < b.key),
  pairs AS (SELECT doc_a, doc_b, list_sum(list_transform(range(1, 129), lambda i: CASE WHEN x.g[i] = y.g[i] THEN 1 ELSE 0 END)) / 128::DOUBLE AS similarity
    FROM cand JOIN sg x ON x.key = doc_a JOIN sg y ON y.key = doc_b)"""
_FRAG = f"""WITH {_windows('bw', 'benchmark', 'item_id', 'text', 13)}, {_windows('dw', 'documents', 'doc_id', 'text', 13)},
  frag AS (SELECT bw.k AS item_id, dw.k AS doc_id, count(DISTINCT bw.h) AS n_shared FROM bw JOIN dw USING (h) GROUP BY 1, 2)"""
_X = lambda t, p: f"list_distinct(regexp_extract_all({t}, '{p}'))"


def _jac(p: str) -> str:
    a, b = _X("a", p), _X("b", p)
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN 1::DOUBLE ELSE len(list_intersect({a}, {b})) / {union}::DOUBLE END"


def _some(p: str) -> str:
    return f"(len({_X('a', p)}) > 0 AND len({_X('b', p)}) > 0)"


_ROWS = lambda f: f"{f}(len(string_split(a, chr(10))), len(string_split(b, chr(10))))::DOUBLE"
_ID, _NUM = "[A-Za-z_][A-Za-z0-9_]*", "[0-9]+"
_MATCH = f"{_FRAG}, m AS (SELECT item_id, least(1::DOUBLE, 0.4::DOUBLE + n_shared / 40::DOUBLE) AS c FROM frag)"
_RISK = f"""{_MATCH}, s AS (SELECT item_id, count(*) FILTER (c >= 0.8::DOUBLE) AS n_high, count(*) FILTER (c >= 0.5::DOUBLE AND c < 0.8::DOUBLE) AS n_middle, max(c) AS best FROM m GROUP BY 1),
  r AS (SELECT item_id, coalesce(n_high, 0) AS n_high, coalesce(n_middle, 0) AS n_middle, best FROM benchmark LEFT JOIN s USING (item_id)),
  risk AS (SELECT *, CASE WHEN n_high >= 2 OR best >= 0.9::DOUBLE THEN 'high' WHEN n_high >= 1 OR n_middle >= 2 THEN 'medium' WHEN n_middle >= 1 THEN 'low' ELSE 'none' END AS risk FROM r)"""
_EV = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"

ORACLES = {
    "exact_duplicates": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "clone_members": f"WITH {_DISTINCT} SELECT doc_id, key AS representative FROM documents LEFT JOIN dt USING (text)",
    "token_windows": f"{_SHARED}, s AS (SELECT h, count(DISTINCT k) AS n_docs FROM win GROUP BY h HAVING count(DISTINCT k) > 1) SELECT n_docs, count(*) AS n_windows FROM s GROUP BY 1",
    "clone_pairs": f"{_CLONES} SELECT * FROM clones",
    "longest_clones": f"""{_CLONES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_a, doc_b ORDER BY n_tokens DESC, start_a, start_b) AS r FROM clones)
      SELECT doc_a, doc_b, n_tokens, least(1::DOUBLE, 0.5::DOUBLE + n_tokens / 500::DOUBLE * 0.5::DOUBLE) AS confidence FROM r WHERE r = 1""",
    "skeleton_groups": f"""SELECT md5({_NORM("regexp_replace(regexp_replace(text, '\\p{L}+', 'W', 'g'), '[0-9]+', 'N', 'g')")}) AS skeleton, count(*) AS n, min(doc_id) AS first
      FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "minhash_signatures": f"WITH {_SIGS('documents', 'doc_id')} SELECT key AS doc_id, array_to_string(g, ',') AS signature FROM sg",
    "lsh_pairs": f"{_LSH} SELECT * FROM pairs WHERE similarity >= 0.5::DOUBLE",
    "jaccard_pairs": f"""{_LSH} SELECT doc_a, doc_b, len(list_intersect(x.s, y.s))::BIGINT AS n_common, len(list_distinct(list_concat(x.s, y.s)))::BIGINT AS n_union
      FROM pairs JOIN sh x ON x.key = doc_a JOIN sh y ON y.key = doc_b WHERE similarity >= 0.5::DOUBLE""",
    "fragment_search": f"{_FRAG} SELECT * FROM frag",
    "clone_confidence": f"""{_FRAG}, p AS (SELECT item_id, doc_id, benchmark.text AS a, documents.text AS b FROM frag JOIN benchmark USING (item_id) JOIN documents USING (doc_id))
      SELECT item_id, doc_id, floor(least(0.95::DOUBLE, 0.7::DOUBLE * ({_jac(clones._SYMBOLS)}) + 0.3::DOUBLE * {_ROWS('least')} / {_ROWS('greatest')}) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS confidence,
        {_some(_ID)} AND ({_jac(_ID)}) < 0.5::DOUBLE AS renamed, {_some(_NUM)} AND ({_jac(_NUM)}) < 0.3::DOUBLE AS literal_differs FROM p""",
    "merged_findings": f"""{_ALL}, s AS (SELECT path, line_no AS "start", line_no + 2 AS "end", rule_id AS method, least(1::DOUBLE, 0.5::DOUBLE + n / 10::DOUBLE) AS confidence FROM found),
      n AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY path ORDER BY "start", "end", method ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
      i AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY "start", "end", method ROWS UNBOUNDED PRECEDING) AS island FROM n)
      SELECT path, min("start") AS "start", max("end") AS "end", CASE WHEN min(method) = max(method) THEN min(method) ELSE 'both' END AS method, max(confidence) AS confidence, count(*) AS n_merged FROM i GROUP BY path, island""",
    "plan_risk": f"{_RISK} SELECT * FROM risk",
    "overall_risk": f"""{_RISK}, o AS (SELECT count(*) AS n_steps, count(*) FILTER (risk = 'high') AS n_high, count(*) FILTER (risk = 'medium') AS n_medium FROM risk)
      SELECT *, CASE WHEN n_high > 0 AND n_high >= n_steps / 2::DOUBLE THEN 'high' WHEN n_high > 0 OR (n_medium > 0 AND n_medium >= n_steps / 3::DOUBLE) THEN 'medium' ELSE 'low' END AS risk FROM o""",
    "text_search": f"""WITH d AS (SELECT doc_id, {_W('lower(text)')} AS w FROM documents),
      h AS (SELECT doc_id, len(w) AS n, term, len(list_filter(w, lambda x: x = term))::BIGINT AS tf FROM d, unnest(['token', 'licensed', 'and']) AS t(term)),
      r AS (SELECT term, ln(1::DOUBLE + (SELECT count(*) FROM documents) / count(*)::DOUBLE) AS idf FROM h WHERE tf > 0 GROUP BY term),
      s AS (SELECT doc_id AS key, floor(sum(tf / n::DOUBLE * idf) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS score FROM h JOIN r USING (term) WHERE tf > 0 GROUP BY 1)
      SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM s ORDER BY score DESC, key LIMIT 20""",
    "symbol_usages": f"WITH {CORPUS}, {LINES} SELECT path, line_no, s AS symbol FROM lines, unnest(['license', 'token']) AS t(s) WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])' || s || '([^A-Za-z0-9_]|\\z)')",
    "error_islands": """WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
      g AS (SELECT user_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) <= 3 THEN 0 ELSE 1 END AS new FROM p WHERE event_type = 'error'),
      i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM g)
      SELECT user_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS size FROM i GROUP BY user_id, island HAVING count(*) >= 2""",
    "carry_scope": f"SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup_id FROM events",
    "running_balance": f"""WITH s AS (SELECT event_id, user_id, ts, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) OVER w AS s FROM events {_EV})
      SELECT event_id, (s - least(0, min(s) OVER w))::BIGINT AS depth FROM s {_EV}""",
    "event_props": "SELECT event_type, sum((props->>'k')::INT)::BIGINT AS sum_k, max((props->>'k')::INT)::BIGINT AS max_k, count(props->>'k') AS n FROM events GROUP BY 1",
    "tumbling": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n_events FROM events GROUP BY 1, 2",
    "sliding": """SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE) AS start_us, event_type, count(*) AS n_events
      FROM events, unnest([0, 1]) AS t(k) GROUP BY 1, 2""",
    "session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
      i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
      SELECT epoch_us(min(ts)) AS start_us, user_id, count(*) AS n_events FROM i GROUP BY user_id, s""",
    "vector_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 0)
      SELECT vec_id, floor(list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS similarity
      FROM v, q WHERE vec_id <> 0 ORDER BY similarity DESC, vec_id LIMIT 5""",
}
