"""One function for each tool of the engine; every one returns a DataFrame unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import lines
from lodestone.operators import clones, code, extract, findings, graph, layers, metrics, programs, rewrite, routing, rules, sequences, store
from lodestone.sources import inline
from lodestone.tables import written

CATALOGUE: list[rules.Rule] = list(rules.TEXT_RULES)


def symbol_definitions(corpus: DataFrame) -> DataFrame:
    """Outline and squeezed text of files."""
    return extract.outline(extract.facts(corpus)).join(rewrite.squeeze_code(corpus), ["repository", "path"], "full")


def load_manifest(text: str) -> layers.Manifest:
    return layers.parse_manifest(text)


check_layers, check_layers_of_diff = layers.check_files, layers.check_diff


def index_codebase(spark: SparkSession, corpus: DataFrame, path: str, repository: str = "default") -> dict[str, int]:
    """Indexes a repository into the store at a path, in place of what it held, as one commit; returns
    counts."""
    own = store.GraphStore(spark, path)
    nodes, edges = graph.index(*extract.fact_tables(written(extract.facts(corpus))), corpus)
    nodes, edges = written(nodes), written(edges)
    count = nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("node_count"))
    files = corpus.select(F.col("path").alias("file_path"), "repository", F.sha2("content", 256).alias("file_hash")).join(count, "file_path", "left")
    files = files.select("file_path", "repository", "file_hash", F.coalesce("node_count", F.lit(0)).alias("node_count"), F.current_timestamp().alias("indexed_at"))
    own.replace_repository(repository, written(files), nodes, edges)
    return {name: own.read(name).count() for name in ("nodes", "edges", "indexed_files")}


def usages(corpus: DataFrame, symbol: str) -> DataFrame:
    """repository, path, line_no, line, scope: lines that use a symbol, without those that declare it,
    with the class or function whose head stands last above."""
    import re

    s = re.escape(symbol)
    head = r"\b(?:class|interface|function|def|func|fn)\s+(\w+)"
    each = lines(corpus.select("repository", "path", "content"), "content")
    each = sequences.carried(each, ["repository", "path"], ["line_no"], F.nullif(F.regexp_extract("line", head, 1), F.lit("")), "scope")
    declares = rf"\b(?:class|interface|function|def|func|fn|const|let|var|type)\s+{s}\b"
    return each.where(F.col("line").rlike(rf"\b{s}\b") & ~F.col("line").rlike(declares))


def symbol_references(corpus: DataFrame, symbol: str) -> DataFrame:
    """Definitions and usages of a symbol, told apart by kind."""
    found = extract.facts(corpus).where((F.col("fact") == "declaration") & (F.col("name") == symbol))
    defined = found.select("repository", "path", F.col("line").alias("line_no"), F.lit("definition").alias("kind"))
    return defined.unionByName(usages(corpus, symbol).select("repository", "path", "line_no", F.lit("usage").alias("kind")))


def doc_mentions(corpus: DataFrame, symbol: str) -> DataFrame:
    return usages(corpus.where(F.col("path").endswith(".md")), symbol).select("repository", "path", "line_no", "line")


def symbol_insights(corpus: DataFrame, symbol: str) -> DataFrame:
    found = symbol_references(corpus, symbol)
    return found.unionByName(doc_mentions(corpus, symbol).select("repository", "path", "line_no", F.lit("mention").alias("kind")))


def scan_patterns(corpus: DataFrame, categories=None, severities=None, ids=None, max_files: int | None = None) -> DataFrame:
    """Findings of the code rules and of the catalogue's declarative rules, in all files or the first ones."""
    corpus = corpus if max_files is None else written(first_files(corpus, max_files))
    built_in = code.scan(corpus)
    for column, allowed in (("category", categories), ("severity", severities), ("pattern_id", ids)):
        if allowed is not None:
            built_in = built_in.where(F.col(column).isin(*allowed))
    own = rules.select(rules.distinct(CATALOGUE), categories, severities, ids)
    return built_in.unionByName(rules.scan(corpus, own)) if own else built_in


def pattern_catalogue(spark: SparkSession) -> DataFrame:
    return rules.catalogue(spark, rules.distinct(CATALOGUE))


def learn_pattern(name: str, pattern: str, **more) -> rules.Rule:
    CATALOGUE.append(rule := rules.learned(name, pattern, **more))
    return rule


def _imported(corpus: DataFrame) -> DataFrame:
    found = graph.resolve_imports(extract.fact_tables(extract.facts(corpus))[0], corpus).where("target IS NOT NULL")
    return found.select(F.col("path").alias("src"), F.col("target").alias("dst"))


def circular_dependencies(corpus: DataFrame, longest: int = 8) -> DataFrame:
    return graph.cycles(_imported(corpus), longest)


def circular_files(corpus: DataFrame) -> DataFrame:
    """node, component: every file on a cycle of imports, however long."""
    return graph.cycle_components(_imported(corpus))


def find_clones(corpus: DataFrame, fragment: str, least: float = 0.3, limit: int = 20) -> DataFrame:
    """path, confidence, renamed, literal_differs: files like a fragment, best first."""
    own = corpus.select("repository", "path", "content").withColumn("fragment", F.lit(fragment))
    return clones.confidence(own, "fragment", "content").where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "repository", "path").limit(limit).drop("content", "fragment")


def blueprint_search(corpus: DataFrame, limit: int = 50, size: int = clones.TILE, least: float = clones.LEAST) -> DataFrame:
    """path, start, end (lines), method, confidence, n_merged: token and structural clones of a corpus as
    merged findings, best first."""
    runs, shapes = written(programs.code_clones(corpus, size)), written(programs.structural_clones(corpus, least))
    token = F.least(F.lit(1.0), 0.5 + F.col("n_tokens") / 500 * 0.5)
    side = lambda df, x, method, c: df.select(F.col(f"file_{x}").alias("path"), F.col(f"start_{x}").alias("start"), F.col(f"end_{x}").alias("end"), F.lit(method).alias("method"), c.alias("confidence"))
    found = side(runs, "a", "token", token).unionByName(side(runs, "b", "token", token))
    for x in "ab":
        found = found.unionByName(side(shapes, x, "structure", F.col("similarity")))
    return clones.merged(found.distinct()).orderBy(F.desc("confidence"), "path", "start").limit(limit)


def code_clones(corpus: DataFrame, size: int = clones.TILE) -> DataFrame:
    """Clones of program text by normalised tokens, longest first."""
    return programs.code_clones(corpus, size).orderBy(F.desc("n_tokens"), "file_a", "file_b", "start_a", "start_b")


def structural_clones(corpus: DataFrame, least: float = clones.LEAST) -> DataFrame:
    """Blocks of one shape in different files, most alike first."""
    return programs.structural_clones(corpus, least).orderBy(F.desc("similarity"), "file_a", "file_b", "start_a", "start_b")


def batch_find_clones(corpus: DataFrame, fragments: DataFrame, key: str, text: str, size: int = 8) -> DataFrame:
    """Where files hold parts of many fragments, each place once."""
    return programs.find_fragments(fragments, key, text, corpus, size).dropDuplicates([key, "file", "start_line"])


def first_files(corpus: DataFrame, most: int) -> DataFrame:
    """The first files of a corpus by repository and path."""
    return corpus.orderBy("repository", "path").limit(most)


def estimate(spark: SparkSession, text: str) -> DataFrame:
    return routing.route(routing.estimate(spark.createDataFrame([(text,)], "text string"), "text"))


def decompose(spark: SparkSession, text: str) -> DataFrame:
    return routing.subtasks(spark.createDataFrame([(1, text)], "task long, text string"), "text", ["task"])


def analyze(corpus: DataFrame) -> DataFrame:
    """Metrics, total and tier of each file."""
    return routing.route(metrics.measure(corpus).withColumnRenamed("total", "score"))


def route_code(corpus: DataFrame, strict: bool = False) -> DataFrame:
    own = metrics.measure(corpus, metrics.Registry(metrics.WEIGHTS["route"]))
    return routing.route(own.withColumn("score", F.col("strict") if strict else F.col("total")))


def audit_design(corpus: DataFrame) -> DataFrame:
    return code.scan(corpus, code.DESIGN_RULES)


def audit_changes(head: DataFrame, base: DataFrame) -> DataFrame:
    """Design findings of head that base doesn't have, by file, rule and message."""
    key = ["file_path", "pattern_id", "message"]
    return findings.new_findings(audit_design(head), audit_design(base).select(*key), key)


def injection_template(spark: SparkSession, name: str, parts: list[str]) -> DataFrame:
    """The text of a class that is given its parts."""
    fields = ", ".join(f"private readonly {p[0].lower() + p[1:]}: I{p}" for p in parts)
    text = "\n".join([*(f"export interface I{p} {{}}" for p in parts), f"export class {name} {{", f"  constructor({fields}) {{}}", "}"])
    return spark.createDataFrame([(name, text)], "name string, template string")


execute_refactor = rewrite.refactor
squeeze = rewrite.squeeze_code
symbol_tree, symbol_dependencies = graph.call_tree, graph.dependency_map
inline_corpus = inline
