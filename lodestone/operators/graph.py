"""Property-graph queries as bounded joins over nodes(id, repository, type, label, file_path) and
edges(src, dst, type, repository)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.schemas import DECLARATION_TYPES
from lodestone.tables import written

# How far a search goes by its scope, and from how many nodes it starts.
DEPTH = {"project": 3, "module": 2, "file": 1}
SEEDS = 50


def node_id(repository: Column, kind: str, name: Column, path: Column | None = None) -> Column:
    """file:<path> or sym:<name>[@<path>], after the repository's name unless that is the default."""
    prefix = F.when(F.coalesce(repository, F.lit("default")) == "default", F.lit("")).otherwise(F.concat(repository, F.lit("::")))
    rest = F.concat(F.lit(f"{kind}:"), name)
    return F.concat(prefix, rest if path is None else F.concat(rest, F.lit("@"), path))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, "^[^:]+::", "")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst", "type"])


def first_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """Of nodes with one id the first."""
    w = Window.partitionBy("id").orderBy(order)
    return nodes.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def matching(nodes: DataFrame, term: str) -> DataFrame:
    """Nodes whose id or label holds the term, in any case."""
    t = term.lower()
    return nodes.where(F.lower("id").contains(t) | F.lower("label").contains(t))


def seeds(nodes: DataFrame, term: str, path: str | None = None, repository: str | None = None, most: int = SEEDS) -> DataFrame:
    t = term.lower()
    found = nodes.where(F.lower("id").contains(t) | F.lower("label").contains(t) | F.lower(_bare(F.col("id"))).contains(t))
    if path is not None:
        found = found.where(F.col("file_path") == path)
    if repository is not None:
        found = found.where(F.coalesce("repository", F.lit("default")) == repository)
    return found.select("id").orderBy("id").limit(most)


def undirected(edges: DataFrame) -> DataFrame:
    one = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return one.unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))).distinct()


def neighbourhood(start: DataFrame, edges: DataFrame, depth: int = DEPTH["project"]) -> DataFrame:
    """id, depth: all nodes within so many steps of the start nodes, with the fewest steps.  The depth
    is small and bounded; each step looks only at what is new, and is written, so that no step is
    computed again."""
    both = written(undirected(edges))
    reached = start.select("id").distinct().withColumn("depth", F.lit(0).cast("long"))
    frontier = reached.select("id")
    for d in range(1, depth + 1):
        step = both.join(frontier.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct()
        frontier = written(step.join(reached.select("id"), "id", "left_anti"))
        reached = reached.unionByName(frontier.withColumn("depth", F.lit(d).cast("long")))
    return reached


def touched_edges(reached: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Edges of nodes that were expanded, which are those within fewer steps than the depth."""
    ids = reached.where(F.col("depth") < depth).select(F.col("id").alias("x"))
    out = edges.join(ids.withColumnRenamed("x", "src"), "src", "left_semi").select(*edges.columns)
    return out.unionByName(edges.join(ids.withColumnRenamed("x", "dst"), "dst", "left_semi").select(*edges.columns)).distinct()


def references(nodes: DataFrame, edges: DataFrame, symbol: str, prefix: str | None = None) -> DataFrame:
    """id, referrers: who imports or calls the matching nodes, sorted.  With a path prefix only
    referrers below it count, and nodes without any go; else they stay with an empty list."""
    into = edges.where(F.col("type").isin("imports", "calls")).select(F.col("dst").alias("id"), "src")
    into = into.join(nodes.select(F.col("id").alias("src"), F.col("file_path").alias("from_path")), "src")
    if prefix is not None:
        into = into.where(F.col("from_path").startswith(prefix))
    grouped = into.groupBy("id").agg(F.array_sort(F.collect_set("src")).alias("referrers"))
    out = matching(nodes, symbol).select("id").join(grouped, "id", "left" if prefix is None else "inner")
    return out.withColumn("referrers", F.coalesce("referrers", F.array().cast("array<string>")))


def definitions(nodes: DataFrame, symbol: str, path: str | None = None) -> DataFrame:
    """Declarations that a name stands for: by id, by label, or as the last part of an id."""
    bare = _bare(F.col("id"))
    found = F.lit(False)
    for c in (F.col("id"), bare):
        found = found | (c == symbol) | c.endswith("." + symbol)
    found = found | (F.col("label") == symbol) | (_bare(F.col("label")) == symbol)
    out = nodes.where(found & F.col("type").isin(*DECLARATION_TYPES))
    return out if path is None else out.where(F.col("file_path") == path)


def call_tree(start: DataFrame, edges: DataFrame, depth: int = 3, kind: str | None = "calls", incoming: bool = False) -> DataFrame:
    """root, depth, path: the tree of calls from each start node as its paths (array of ids).  Cycles
    are walked until the depth ends, as the tree has no other bound."""
    a, b = ("dst", "src") if incoming else ("src", "dst")
    own = edges if kind is None else edges.where(F.col("type") == kind)
    own = written(own.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct())
    level = start.select(F.col("id").alias("root"), F.col("id").alias("u"), F.array("id").alias("path"))
    out = level.select("root", F.lit(0).cast("long").alias("depth"), "path")
    for d in range(1, depth + 1):
        level = written(level.join(own, "u").select("root", F.col("v").alias("u"), F.concat("path", F.array("v")).alias("path")))
        out = out.unionByName(level.select("root", F.lit(d).cast("long").alias("depth"), "path"))
    return out


def call_hierarchy(start: DataFrame, edges: DataFrame, direction: str = "both", depth: int = 3, kind: str | None = "calls") -> DataFrame:
    """direction, root, depth, path: the trees of callers (incoming), of what is called (outgoing), or both."""
    sides = {"incoming": (True,), "outgoing": (False,), "both": (True, False)}[direction]
    trees = [call_tree(start, edges, depth, kind, into).select(F.lit("incoming" if into else "outgoing").alias("direction"), "root", "depth", "path") for into in sides]
    return trees[0] if len(trees) == 1 else trees[0].unionByName(trees[1])


def dependency_map(edges: DataFrame, kind: str | None = "imports") -> DataFrame:
    """src, targets: what each node depends on, sorted."""
    own = edges if kind is None else edges.where(F.col("type") == kind)
    return own.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def cycles(edges: DataFrame, longest: int = 8) -> DataFrame:
    """cycle: simple directed cycles of up to so many nodes, each once, from its smallest node on;
    cycle_components has the nodes of cycles of any length.
    A walk only visits nodes above the one it began at, so each cycle is found from one start."""
    own = written(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct())
    walk = own.where("v >= u").select(F.col("u").alias("first"), F.array("u").alias("path"), F.col("v").alias("u"))
    out = None
    for _ in range(longest):
        walk = written(walk)
        closed = walk.where("u = first").select(F.col("path").alias("cycle"))
        out = closed if out is None else out.unionByName(closed)
        walk = walk.where((F.col("u") != F.col("first")) & ~F.array_contains("path", F.col("u")))
        walk = walk.select("first", F.concat("path", F.array("u")).alias("path"), "u").join(own, "u").where("v >= first").select("first", "path", F.col("v").alias("u"))
    return out


def _settled(values: DataFrame, edges: DataFrame) -> DataFrame:
    """id, c: each node's least value after values went along the edges (u, v) until none changed."""
    while True:
        come = values.join(edges, values["id"] == edges["u"]).groupBy(F.col("v").alias("id")).agg(F.min("c").alias("d"))
        step = values.join(come, "id", "left").select("id", F.least("c", "d").alias("c"), (F.col("d") < F.col("c")).alias("less"))
        step = written(step)
        values = step.select("id", "c")
        if not step.where("less").limit(1).count():
            return values


def cycle_components(edges: DataFrame) -> DataFrame:
    """node, component: the nodes that lie on a cycle, of whatever length, with the smallest node of
    their strongly connected component.  Edges off all cycles are trimmed; each node gets the smallest
    node that reaches it, and the nodes that reach that one in turn are a component, which leaves.
    Rounds grow with the length of the longest way."""
    own = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct()
    own = written(own)
    out, loops = None, own.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    own = written(own.where("u <> v"))
    n = own.count()
    while n:
        ins, outs = own.select(F.col("v").alias("u")).distinct(), own.select(F.col("u").alias("v")).distinct()
        left = written(own.join(ins, "u", "left_semi").join(outs, "v", "left_semi").select("u", "v"))
        before, own, n = n, left, left.count()
        if n < before:
            continue
        nodes = own.select(F.col("u").alias("id")).union(own.select("v")).distinct()
        colour = _settled(nodes.withColumn("c", F.col("id")), own)
        ends = own.join(colour.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(colour.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v")
        back = written(ends.where("cu = cv").select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Against the edges within a colour, from its smallest node.
        found = _settled(colour.select("id", F.struct((F.col("id") != F.col("c")).cast("int").alias("far"), "c").alias("c")), back)
        found = found.where("c.far = 0").select(F.col("id").alias("node"), F.col("c.c").alias("component"))
        out = found if out is None else out.unionByName(found)
        gone = found.select("node")
        own = written(own.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v"))
        n = own.count()
    if out is None:
        return loops
    several = out.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("component"))).where("size > 1").drop("size")
    return several.unionByName(loops.join(several.select("node"), "node", "left_anti"))


# Fixed values, in the order in which they are tried.
SUFFIXES = [
    "", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".py", "/index.ts", "/index.js", "/index.tsx",
    "/index.jsx", "/index.mjs",
]


def normal_path(path: Column) -> Column:
    """The path without . and .. parts; a leading slash stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), folded)).otherwise(folded)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """repository, path, source, target: relative imports with the file that they mean, or null.  Every
    import is tried with each of a fixed list of suffixes, the first file found holds."""
    relative = imports.where(F.col("source").startswith("."))
    base = normal_path(F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("source")))
    tried = F.posexplode(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(F.col("__b"), s)))
    each = relative.select("repository", "path", "source", base.alias("__b")).select("repository", "path", "source", tried.alias("o", "target"))
    known = files.select("repository", F.col("path").alias("target")).distinct()
    best = each.join(known, ["repository", "target"]).groupBy("repository", "path", "source").agg(F.min_by("target", "o").alias("target"))
    return relative.select("repository", "path", "source").distinct().join(best, ["repository", "path", "source"], "left")


def index(imports: DataFrame, declarations: DataFrame, relationships: DataFrame, files: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of extracted facts.  An import that means no file of the corpus is a file node of
    its own, named by its source; a default import is an edge to the symbol of that name besides.  A relationship's target is the declaration of that name in the
    repository, the first by path; a target that is declared nowhere gives no edge.  known: further files
    (repository, path) that imports may mean."""
    col, none = F.col, F.create_map().cast("map<string,string>")
    file_nodes = files.select("repository", "path").distinct()
    nodes = file_nodes.select(node_id(col("repository"), "file", col("path")).alias("id"), "repository", F.lit("file").alias("type"), F.regexp_extract("path", "[^/]*$", 0).alias("label"), col("path").alias("file_path"))
    symbols = declarations.select(node_id(col("repository"), "sym", col("name"), col("path")).alias("id"), "repository", col("kind").alias("type"), col("name").alias("label"), col("path").alias("file_path")).distinct()
    every = files.select("repository", "path") if known is None else files.select("repository", "path").unionByName(known.select("repository", "path"))
    relative = resolve_imports(imports, every)
    resolved = relative.where("target IS NOT NULL")
    outside = imports.where(~col("source").startswith(".")).select("repository", "path", "source").distinct().unionByName(relative.where("target IS NULL").select("repository", "path", "source"))
    outside = outside.withColumn("id", node_id(col("repository"), "file", col("source")))
    externals = outside.select("id", "repository", F.lit("file").alias("type"), F.regexp_extract("source", "[^/]*$", 0).alias("label"), col("source").alias("file_path")).distinct()
    externals = externals.join(nodes.select("id"), "id", "left_anti")
    default = imports.where(col("default_name").isNotNull()) if "default_name" in imports.columns else imports.withColumn("default_name", F.lit(None).cast("string")).where("false")
    edges = resolved.select(node_id(col("repository"), "file", col("path")).alias("src"), node_id(col("repository"), "file", col("target")).alias("dst"), F.lit("imports").alias("type"), "repository")
    edges = edges.unionByName(outside.select(node_id(col("repository"), "file", col("path")).alias("src"), col("id").alias("dst"), F.lit("imports").alias("type"), "repository"))
    edges = edges.unionByName(default.select(node_id(col("repository"), "file", col("path")).alias("src"), node_id(col("repository"), "sym", col("default_name")).alias("dst"), F.lit("imports").alias("type"), "repository"))
    edges = edges.unionByName(symbols.select(node_id(col("repository"), "file", col("file_path")).alias("src"), col("id").alias("dst"), F.lit("defines").alias("type"), "repository"))
    target = symbols.groupBy("repository", "label").agg(F.min_by("id", "file_path").alias("dst"))
    related = relationships.join(target, (relationships["repository"] == target["repository"]) & (relationships["target"] == target["label"]))
    edges = edges.unionByName(related.select(node_id(relationships["repository"], "sym", col("source"), col("path")).alias("src"), "dst", col("kind").alias("type"), relationships["repository"]))
    return nodes.unionByName(symbols).unionByName(externals).withColumn("metadata", none), distinct_edges(edges).withColumn("metadata", none)
