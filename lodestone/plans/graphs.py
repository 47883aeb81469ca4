"""Graph, layer, store and change-detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph, layers
from lodestone.plans.common import corpus, table


def _page_links(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "html")
    return pages.select("page_id", "host", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def page_graph_nodes(spark, d):
    links = _page_links(spark, d)
    hosts = table(spark, d, "pages").select(F.concat(F.lit("file:"), F.regexp_extract("url", "://([^/?#]*)", 1)).alias("id"), F.lit("file").alias("type"))
    return hosts.unionByName(links.select(F.concat(F.lit("sym:"), F.col("href")).alias("id"), F.lit("export").alias("type"))).distinct()


def page_graph_edges(spark, d):
    """Hosts and what they link to, with how often."""
    links = _page_links(spark, d)
    return links.groupBy(F.concat(F.lit("file:"), F.col("host")).alias("src"), F.concat(F.lit("sym:"), F.col("href")).alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def _star_nodes(spark, d):
    kind = lambda t, k, name, of: table(spark, d, t).select(F.concat(F.lit(f"{t}:"), F.col(k).cast("string")).alias("id"), F.lit("default").alias("repository"), F.lit(of).alias("type"), F.col(name).alias("label"), F.lit(t).alias("file_path"))
    out = kind("region", "r_regionkey", "r_name", "class")
    for x in (("nation", "n_nationkey", "n_name", "interface"), ("supplier", "s_suppkey", "s_name", "function"), ("customer", "c_custkey", "c_name", "variable")):
        out = out.unionByName(kind(*x))
    return out


def _star_edges(spark, d):
    link = lambda t, k, to, f, of: table(spark, d, t).select(F.concat(F.lit(f"{t}:"), F.col(k).cast("string")).alias("src"), F.concat(F.lit(f"{to}:"), F.col(f).cast("string")).alias("dst"), F.lit(of).alias("type"), F.lit("default").alias("repository"))
    out = link("nation", "n_nationkey", "region", "n_regionkey", "imports")
    out = out.unionByName(link("supplier", "s_suppkey", "nation", "s_nationkey", "calls"))
    return out.unionByName(link("customer", "c_custkey", "nation", "c_nationkey", "extends"))


def valid_edges(spark, d):
    """Customer edges whose nation is one of those that suppliers are in."""
    nodes = _star_edges(spark, d).where("type = 'calls'").select(F.col("dst").alias("id")).unionByName(_star_nodes(spark, d).where("file_path = 'customer'").select("id"))
    return graph.valid_edges(nodes, _star_edges(spark, d)).select("src", "dst", "type")


def bfs_subgraph(spark, d):
    start = graph.seeds(_star_nodes(spark, d).where("file_path = 'region'"), "asia")
    return graph.neighbourhood(start, _star_edges(spark, d), 3)


def bfs_edges(spark, d):
    reached = bfs_subgraph(spark, d)
    return graph.touched_edges(reached, _star_edges(spark, d), 2).groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"))


def find_references(spark, d):
    out = graph.references(_star_nodes(spark, d), _star_edges(spark, d), "nation:1")
    return out.select("id", F.size("referrers").cast("long").alias("n"), F.array_join("referrers", ",").alias("referrers"))


def find_definitions(spark, d):
    return graph.definitions(_star_nodes(spark, d), "ASIA").select("id", "type", "label")


def _trade(spark, d):
    """Supplier nation to customer nation: how many line items."""
    line, order = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    supplier, customer = table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    both = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(order, line["l_orderkey"] == order["o_orderkey"]).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy(F.col("s_nationkey").cast("long").alias("a"), F.col("c_nationkey").cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _partners(spark, d):
    """The most frequent other nation of each nation, as edges."""
    best = _trade(spark, d).where("a <> b").groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    return best.select(F.format_string("n%02d", "a").alias("src"), F.format_string("n%02d", "b").alias("dst"), F.lit("calls").alias("type"))


def call_tree(spark, d):
    edges = _partners(spark, d)
    out = graph.call_tree(edges.select(F.col("src").alias("id")), edges, 3)
    return out.select("root", "depth", F.array_join("path", ">").alias("path"))


def dependency_map(spark, d):
    edges = _trade(spark, d).where("n > 0 AND a <> b").select(F.col("a").cast("string").alias("src"), F.format_string("%02d", "b").alias("dst"))
    return graph.dependency_map(edges, None).select("src", F.array_join("targets", ",").alias("targets"))


def cycles(spark, d):
    return graph.cycles(_partners(spark, d), 8).select(F.array_join("cycle", ">").alias("cycle"))


def cycle_components(spark, d):
    return graph.cycle_components(_partners(spark, d))


ALLOWED = {0: (1,), 1: (2,), 2: (3,), 3: (4,), 4: (0,)}


def layer_violations(spark, d):
    """Trade between regions that no layer rule allows: each region may only buy from the next."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
    trade = _trade(spark, d)
    own = trade.join(F.broadcast(nation.select(F.col("k").alias("a"), F.col("r").alias("to_layer"))), "a").join(F.broadcast(nation.select(F.col("k").alias("b"), F.col("r").alias("from_layer"))), "b")
    allowed = spark.createDataFrame([(a, b) for a, bs in ALLOWED.items() for b in bs], "from_layer long, to_layer long")
    own = own.where("from_layer <> to_layer").join(F.broadcast(allowed), ["from_layer", "to_layer"], "left_anti")
    return own.groupBy("from_layer", "to_layer").agg(F.sum("n").cast("long").alias("n"))


def needs_reindex(spark, d):
    """Documents against stored hashes: a third are stored as they are, a third altered, a third not."""
    from lodestone.operators.store import change_status

    now = corpus(spark, d).select("repository", F.col("path").alias("file_path"), F.md5(F.col("content").cast("binary")).alias("file_hash"))
    old = now.where(F.col("file_path").cast("long") % 3 < 2)
    altered = F.when(F.col("file_path").cast("long") % 3 == 1, F.concat(F.lit("x"), F.col("file_hash"))).otherwise(F.col("file_hash"))
    return change_status(now, old.withColumn("file_hash", altered)).select("file_path", "status")


def doc_annotations(spark, d):
    """Documents by language, with how many have labels and how many bad ones."""
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")
    notes = labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("toxic").alias("toxic"))
    return docs.join(notes, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.count("n").alias("n_annotated"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


def graph_upsert(spark, d):
    """Nation nodes replaced by new ones where both exist, all others kept."""
    from lodestone.operators.store import upsert

    old = _star_nodes(spark, d).select("id", "label")
    new = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.lower("n_name").alias("label"))
    new = new.unionByName(spark.createDataFrame([("nation:new", "new")], "id string, label string"))
    return upsert(old, new, ["id"])


_Q = [page_graph_nodes, page_graph_edges, valid_edges, bfs_subgraph, bfs_edges, find_references, find_definitions, call_tree, dependency_map, cycles, cycle_components, layer_violations, needs_reindex, doc_annotations, graph_upsert]
QUERIES = {f.__name__: f for f in _Q}

_LINKS = """links AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""
_STAR = """nodes AS (
    SELECT 'region:' || r_regionkey AS id, 'class' AS type, r_name AS label, 'region' AS f FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'interface', n_name, 'nation' FROM nation
    UNION ALL SELECT 'supplier:' || s_suppkey, 'function', s_name, 'supplier' FROM supplier
    UNION ALL SELECT 'customer:' || c_custkey, 'variable', c_name, 'customer' FROM customer),
  edges AS (
    SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'imports' AS type FROM nation
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'calls' FROM supplier
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'extends' FROM customer)"""
_BFS = f"""{_STAR}, ways AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges),
  walk AS (SELECT id, 0 AS depth FROM nodes WHERE f = 'region' AND contains(lower(label), 'asia')
    UNION SELECT v, depth + 1 FROM walk JOIN ways ON u = id WHERE depth < 3),
  reached AS (SELECT id, min(depth)::BIGINT AS depth FROM walk GROUP BY id)"""
_TRADE = """trade AS (SELECT s_nationkey::BIGINT AS a, c_nationkey::BIGINT AS b, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  partner AS (SELECT printf('n%02d', a) AS src, printf('n%02d', b) AS dst FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM trade WHERE a <> b) WHERE r = 1)"""

ORACLES = {
    "page_graph_nodes": f"""WITH {_LINKS} SELECT DISTINCT 'file:' || regexp_extract(url, '://([^/?#]*)', 1) AS id, 'file' AS type FROM pages UNION SELECT 'sym:' || href, 'export' FROM links""",
    "page_graph_edges": f"WITH {_LINKS} SELECT 'file:' || host AS src, 'sym:' || href AS dst, count(*) AS n FROM links GROUP BY 1, 2",
    "valid_edges": f"""WITH {_STAR}, ok AS (SELECT dst AS id FROM edges WHERE type = 'calls' UNION SELECT id FROM nodes WHERE f = 'customer')
      SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM ok) AND dst IN (SELECT id FROM ok)""",
    "bfs_subgraph": f"WITH RECURSIVE {_BFS} SELECT * FROM reached",
    "bfs_edges": f"""WITH RECURSIVE {_BFS}, x AS (SELECT id FROM reached WHERE depth < 2)
      SELECT type, count(*) AS n_edges FROM (SELECT DISTINCT * FROM edges WHERE src IN (SELECT id FROM x) OR dst IN (SELECT id FROM x)) GROUP BY 1""",
    "find_references": f"""WITH {_STAR}, i AS (SELECT dst AS id, src FROM edges WHERE type IN ('imports', 'calls')),
      g AS (SELECT id, count(DISTINCT src) AS n, string_agg(DISTINCT src, ',' ORDER BY src) AS referrers FROM i GROUP BY id)
      SELECT nodes.id, coalesce(n, 0) AS n, coalesce(referrers, '') AS referrers FROM nodes LEFT JOIN g USING (id) WHERE contains(lower(nodes.id), 'nation:1') OR contains(lower(label), 'nation:1')""",
    "find_definitions": f"WITH {_STAR} SELECT id, type, label FROM nodes WHERE label = 'ASIA' OR id = 'ASIA' OR ends_with(id, '.ASIA')",
    "call_tree": f"""WITH RECURSIVE {_TRADE}, t AS (SELECT src AS root, 0 AS depth, src AS path, src AS u FROM partner
      UNION ALL SELECT root, depth + 1, path || '>' || dst, dst FROM t JOIN partner ON src = u WHERE depth < 3) SELECT root, depth::BIGINT AS depth, path FROM t""",
    "dependency_map": f"WITH {_TRADE} SELECT a::VARCHAR AS src, string_agg(printf('%02d', b), ',' ORDER BY b) AS targets FROM trade WHERE a <> b GROUP BY a",
    "cycles": f"""WITH RECURSIVE {_TRADE}, w AS (SELECT src AS first, [src] AS p, dst AS u FROM partner WHERE dst >= src
      UNION ALL SELECT first, list_append(p, u), dst FROM w JOIN partner ON src = u WHERE u <> first AND NOT list_contains(p, u) AND dst >= first AND len(p) < 8)
      SELECT array_to_string(p, '>') AS cycle FROM w WHERE u = first""",
    "cycle_components": f"""WITH RECURSIVE {_TRADE}, reach AS (SELECT src AS a, dst AS b FROM partner UNION SELECT a, dst FROM reach JOIN partner ON src = b)
      SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1""",
    "layer_violations": f"""WITH {_TRADE} SELECT y.n_regionkey::BIGINT AS from_layer, x.n_regionkey::BIGINT AS to_layer, sum(n)::BIGINT AS n
      FROM trade JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b
      WHERE x.n_regionkey <> y.n_regionkey AND x.n_regionkey <> (y.n_regionkey + 1) % 5 GROUP BY 1, 2""",
    "needs_reindex": "SELECT doc_id::VARCHAR AS file_path, CASE doc_id % 3 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'changed' ELSE 'new' END AS status FROM documents",
    "doc_annotations": """WITH n AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1)
      SELECT lang, count(*) AS n_docs, count(n.doc_id) AS n_annotated, count(*) FILTER (toxic = 1) AS n_toxic FROM documents LEFT JOIN n USING (doc_id) GROUP BY 1""",
    "graph_upsert": f"""WITH {_STAR} SELECT id, label FROM nodes WHERE f <> 'nation' UNION ALL SELECT id, lower(label) FROM nodes WHERE f = 'nation' UNION ALL SELECT 'nation:new', 'new'""",
}
