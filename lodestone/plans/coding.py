"""Program text: the scripts of all pages, and sample files of several languages with known faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import api, schemas
from lodestone.operators import code, extract, graph, layers, metrics, programs, rewrite
from lodestone.operators.store import GraphStore
from lodestone.plans.common import corpus, table
from lodestone.sources import inline, scripts_of_pages
from lodestone.streaming import current_index, windowed_errors
from lodestone.tables import scratch

SAMPLES = {
    "src/ui/view.ts": "import { load } from '../data/store';\nimport './style';\n\nexport class View extends Base implements IView {\n  private rows: any = [];\n  draw() { render(this.rows); console.log('drawn'); }\n  save() { throw new Error('not implemented'); }\n  close() {}\n}\n",
    "src/data/store.ts": "import { View } from '../ui/view';\n\nexport class Store {\n  private db = new Database();\n  load(id: number) {\n    switch (id) { case 2: return 7; case 3: return 8; case 4: return 9; case 5: return 10; }\n    return eval('id');\n  }\n}\nexport interface Wide {\n  a(): void;\n  b(): void;\n  c(): void;\n  d(): void;\n  e(): void;\n  f(): void;\n}\n",
    "src/ui/style.ts": "export const width = 80;\n// unused\nconst apiKey = 'abcdef123456';\n",
    "tool/run.py": "import os, json\nfrom lib.base import Base\n\n\nclass Runner(Base):\n    def go(self, seen=[]):\n        try:\n            exec('1')\n        except:\n            pass\n",
    "db/schema.sql": "CREATE TABLE orders (id INT REFERENCES customers);\nCREATE VIEW open_orders AS SELECT * FROM orders;\n",
    "bin/start.sh": "source ./env.sh\nprepare() {\n  echo hi\n}\nmain() {\n  prepare\n}\n",
    "README.md": "The Store keeps rows, the View shows them.\n",
}
#: A file and a renamed copy of a part of it, with other literals and after another beginning.
TWINS = {
    "lib/totals.ts": "import { Row } from './row';\n\nexport function totals(rows: Row[]) {\n  let sum = 0; // of all\n  for (const row of rows) {\n    if (row.price > 10 && row.count) {\n      sum += row.price * row.count;\n    }\n  }\n  return { sum, mean: sum / rows.length };\n}\n",
    "lib/scores.ts": "const least = 'none';\n/* as for\n   totals */\nexport function scores(items: Item[]) {\n  let all = 100;\n  for (const it of items) {\n    if (it.points > 3 && it.weight) {\n      all += it.points * it.weight;\n    }\n  }\n  return { all, part: all / items.length };\n}\n",
    "lib/other.py": "# none of it\ndef other(a):\n    return [x for x in a if x]\n",
}
COMPONENTS = [("src", "app"), ("src/ui", "ui"), ("src/data", "data")]
RELATIONS = [("src", "src/ui", "composes"), ("src/ui", "lib", "uses"), ("src/ui", "src/data", "composes"), ("src", "src/data", "uses")]
MANIFEST = "## Layers\n- ui: depends on [data]\n- data: depends on []\n## Components\n- src/ui: ui\n- src/data: data\n"
DIFF = "diff --git a/src/data/store.ts b/src/data/store.ts\n--- a/src/data/store.ts\n+++ b/src/data/store.ts\n@@ -1,3 +1,4 @@\n import x\n+import { View } from '../ui/view';\n-old\n+import { z } from './z';\n end\n"


def _files(spark, d):
    return scripts_of_pages(table(spark, d, "pages")).unionByName(inline(spark, SAMPLES, "samples"))


def code_rules(spark, d):
    return code.scan(_files(spark, d))


def design_rules(spark, d):
    return api.audit_design(_files(spark, d))


def extract_facts(spark, d):
    return extract.facts(_files(spark, d))


def code_outline(spark, d):
    return extract.outline(extract.facts(_files(spark, d)))


def code_graph_nodes(spark, d):
    files = _files(spark, d)
    return graph.index(*extract.fact_tables(extract.facts(files)), files)[0].drop("metadata")


def code_graph_edges(spark, d):
    files = _files(spark, d)
    return graph.index(*extract.fact_tables(extract.facts(files)), files)[1].drop("metadata")


def circular_dependencies(spark, d):
    return api.circular_dependencies(_files(spark, d)).select(F.array_join("cycle", " > ").alias("cycle"))


def metrics_code(spark, d):
    out = api.analyze(_files(spark, d))
    return out.select("repository", "path", *[F.col("scores")[n].alias(n.replace("-", "_")) for n in metrics.METRICS], "score", "strict", "tier", "effort")


def _programs(spark, d):
    return _files(spark, d).unionByName(inline(spark, TWINS, "twins"))


def program_tokens(spark, d):
    own = programs.tokenised(_programs(spark, d))
    return own.select("file", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


def program_clone_classes(spark, d):
    return programs.clone_classes(_programs(spark, d))


def program_clones(spark, d):
    return programs.code_clones(_programs(spark, d))


def program_fragments(spark, d):
    """Where the body of one file is found again, whatever its names."""
    part = "for (const a of b) {\n if (a.c > 1 && a.d) {\n e += a.c * a.d;"
    fragments = spark.createDataFrame([(1, part)], "fragment_id long, text string")
    return programs.find_fragments(fragments, "fragment_id", "text", _programs(spark, d))


def block_skeletons(spark, d):
    return programs.block_skeletons(_programs(spark, d))


def structural_clones(spark, d):
    return programs.structural_clones(_programs(spark, d))


def _scripts(spark, d):
    return scripts_of_pages(table(spark, d, "pages"))


def script_declarations(spark, d):
    return extract.facts(_scripts(spark, d)).where("fact = 'declaration'").select("repository", "path", "name", "kind", "line")


def script_outline(spark, d):
    return extract.outline(extract.facts(_scripts(spark, d)))


def script_graph_nodes(spark, d):
    files = _scripts(spark, d)
    return graph.index(*extract.fact_tables(extract.facts(files)), files)[0].drop("metadata")


def script_graph_edges(spark, d):
    files = _scripts(spark, d)
    return graph.index(*extract.fact_tables(extract.facts(files)), files)[1].drop("metadata")


def metrics_formulas(spark, d):
    """The metrics that are counts of patterns."""
    out = metrics.measure(_programs(spark, d))
    return out.select("repository", "path", *[F.col("scores")[n].alias(n) for n in ("cyclomatic", "dependencies", "density")])


def squeeze_code(spark, d):
    return rewrite.squeeze_code(_files(spark, d))


def symbol_insights(spark, d):
    return api.symbol_insights(_files(spark, d), "Store")


def layer_check(spark, d):
    return layers.check_files(_files(spark, d), layers.parse_manifest(MANIFEST))


def diff_check(spark, d):
    return layers.check_diff(spark.createDataFrame([(DIFF,)], "diff string"), layers.parse_manifest(MANIFEST))


def component_rules(spark, d):
    components = spark.createDataFrame(COMPONENTS, "path string, layer string")
    relations = spark.createDataFrame(RELATIONS, "source string, target string, type string")
    tag = lambda df, rule: df.select("source", "target", F.lit(rule).alias("rule"))
    return tag(layers.layer_boundary(relations), "boundary").unionByName(tag(layers.unknown_components(relations, components), "unknown")).unionByName(tag(layers.composition(relations), "composition"))


def isolated_files(spark, d):
    components = spark.createDataFrame([("src", "app"), ("src/ui", "ui")], "path string, layer string")
    return layers.isolation(_files(spark, d).select("path"), components)


def large_files(spark, d):
    return layers.large_files(corpus(spark, d), 20).select("path", "n_lines")


def stream_index(spark, d):
    """The documents, streamed into a store: as many files as there are documents."""
    own = scratch(spark)
    corpus(spark, d).write.parquet(f"{own}/corpus")
    store = GraphStore(spark, f"{own}/store")
    current_index(spark, f"{own}/corpus", store, f"{own}/checkpoint", schemas.CORPUS).awaitTermination()
    return store.read("indexed_files").groupBy("repository").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.length("file_hash") == 64).alias("n_hashed"))


def error_windows(spark, d):
    return windowed_errors(table(spark, d, "events")).select(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(start AS TIMESTAMP_NTZ))").alias("start_us"), "n_events", "n_errors")


_Q = [code_rules, design_rules, extract_facts, code_outline, code_graph_nodes, code_graph_edges, circular_dependencies, metrics_code, squeeze_code, symbol_insights, layer_check, diff_check, component_rules, isolated_files, large_files, stream_index, error_windows]
_Q += [program_tokens, program_clone_classes, program_clones, program_fragments, block_skeletons, structural_clones, metrics_formulas]
_Q += [script_declarations, script_outline, script_graph_nodes, script_graph_edges]
QUERIES = {f.__name__: f for f in _Q}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rows(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) AS t({names})"


#: The files in SQL: the pages' scripts, and the samples and twins as rows.
_SAMPLES = [("samples", p, c) for p, c in SAMPLES.items()]
_TWINS = [("twins", p, c) for p, c in TWINS.items()]
_SCRIPTS = r"""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS repository, page_id || '.' || (i - 1) || '.js' AS path, l[i] AS content
      FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS l FROM pages), unnest(range(1, len(l) + 1)) AS t(i)"""
_FILES = f"files AS ({_SCRIPTS} UNION ALL SELECT * FROM {_rows(_SAMPLES, 'repository, path, content')})"
_PROGRAMS = f"files AS ({_SCRIPTS} UNION ALL SELECT * FROM {_rows(_SAMPLES + _TWINS, 'repository, path, content')})"
_FILE_LINES = r"ln AS (SELECT repository, path, i AS line_no, l[i] AS line FROM (SELECT *, string_split_regex(content, '\r?\n') AS l FROM files), unnest(range(1, len(l) + 1)) AS t(i))"


def _tokens_sql() -> str:
    """file, i (over all tokens), norm (null for comments and line ends), line and pos (over kept ones)."""
    words = lambda ws: "(" + ", ".join(map(_quoted, ws)) + ")"
    comment = "(starts_with(t, '//') OR (starts_with(t, '/*') AND ends_with(t, '*/') AND length(t) >= 4) OR (py AND starts_with(t, '#')))"
    return rf"""{_PROGRAMS}, raw AS (
      SELECT repository || '/' || path AS file, lower(path) LIKE '%.py' AS py, regexp_extract_all(content, CASE WHEN lower(path) LIKE '%.py'
        THEN {_quoted(f'({programs.COMMENT}|{programs.PYTHON_ONLY}|{programs.REST})')} ELSE {_quoted(f'({programs.COMMENT}|{programs.REST})')} END) AS l FROM files),
    each AS (SELECT file, py, i, l[i] AS t FROM raw, unnest(range(1, len(l) + 1)) AS u(i)),
    named AS (SELECT *, CASE WHEN t = chr(10) OR {comment} THEN NULL
        WHEN regexp_matches(t, '^[''"`0-9]') THEN 'L'
        WHEN regexp_matches(t, '^[A-Za-z_$]') THEN CASE WHEN (py AND t IN {words(programs.PYTHON_KEYWORDS)}) OR (NOT py AND t IN {words(programs.KEYWORDS)}) THEN t ELSE 'I' END
        WHEN regexp_matches(t, '^[{{}}\[\]();,.]') THEN t ELSE 'O' END AS norm, length(t) - length(replace(t, chr(10), '')) AS ends FROM each),
    placed AS (SELECT *, 1 + coalesce(sum(ends) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line,
        count(norm) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pos FROM named),
    kept AS (SELECT * FROM placed WHERE norm IS NOT NULL),
    whole AS (SELECT file, coalesce(list(norm ORDER BY pos) FILTER (norm IS NOT NULL), []) AS w FROM (SELECT file FROM raw) LEFT JOIN kept USING (file) GROUP BY file)"""


_TOKENS = _tokens_sql()
_WIN = lambda source, size, name="win": f"""{name} AS (SELECT file, (i - 1)::BIGINT AS pos, array_to_string(w[i:i + {size - 1}], ' ') AS h
      FROM {source}, unnest(range(1, len(w) - {size - 2})) AS t(i) WHERE len(w) >= {size})"""  # noqa: E731
_DECIDED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, {}, '', 'g'), {}, '', 'g'), {}, '', 'g'), {}, '', 'g'), {}, '', 'g')"
_N = lambda c, ps: " + ".join(f"len(regexp_extract_all({c}, {_quoted(p)}))" for p in ps)
_TENTH = lambda x: f"floor({x} * 10::DOUBLE + 0.5::DOUBLE) / 10::DOUBLE"
_FOUND = lambda ps: "list_concat(" * (len(ps) - 1) + f"regexp_extract_all(code, {_quoted(ps[0])}, 1)" + "".join(f", regexp_extract_all(code, {_quoted(p)}, 1))" for p in ps[1:])
_DEPTH = "coalesce(list_max(list_transform(list_filter({0}, lambda x: starts_with(x, '.')), lambda x: (length(x) - length(replace(x, '../', ''))) // 3 + CASE WHEN starts_with(x, './') THEN 1 ELSE 0 END)), 0)"
_STEPS = "CASE WHEN p = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN p IN ('.', '') THEN a WHEN a = '' THEN p ELSE a || '/' || p END"
_LAYERS = layers.parse_manifest(MANIFEST)
_VIOLATED = f"""found AS (SELECT file, line_no, unnest(regexp_extract_all(line, {_quoted(layers.IMPORT)}, 1)) AS source FROM added),
    aimed AS (SELECT *, list_reduce(list_concat([''], string_split(regexp_replace(file, '[^/]*$', '') || source, '/')), lambda a, p: {_STEPS}) AS target FROM found),
    comp AS (SELECT * FROM (VALUES {', '.join(f"({i}, {_quoted(p)}, {_quoted(n)})" for i, (p, n) in enumerate(_LAYERS.components))}) AS t(ord, p, layer)),
    allowed AS (SELECT * FROM (VALUES ('', ''){''.join(f", ({_quoted(a)}, {_quoted(b)})" for a, bs in _LAYERS.layers.items() for b in bs)}) AS t(a, b)),
    laid AS (SELECT file, line_no, source, (SELECT min_by(layer, ord) FROM comp WHERE starts_with(file, p) OR starts_with(p, file)) AS from_layer,
        (SELECT min_by(layer, ord) FROM comp WHERE starts_with(target, p) OR starts_with(p, target)) AS to_layer FROM aimed)
    SELECT * FROM laid WHERE from_layer <> to_layer AND NOT EXISTS (SELECT 1 FROM allowed WHERE a = from_layer AND b = to_layer)"""
_DEEP = lambda c: f"len(list_filter(string_split({c}, '/'), lambda x: x <> ''))"
_DECLARED = rf"""{_FILES}, scripts AS (SELECT * FROM files WHERE path LIKE '%.js'), sl AS (SELECT repository, path, i AS line, l[i] AS t FROM (SELECT *, string_split(content, chr(10)) AS l FROM scripts), unnest(range(1, len(l) + 1)) AS u(i)),
    each AS (SELECT repository, path, line, 1 AS o, 'function' AS kind, regexp_extract(t, '^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)', 1) AS name FROM sl
      UNION ALL SELECT repository, path, line, 2, 'class', regexp_extract(t, '^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)', 1) FROM sl
      UNION ALL SELECT repository, path, line, 3, 'variable', regexp_extract(t, '^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)', 1) FROM sl),
    declared AS (SELECT * FROM each WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY repository, path, name ORDER BY o, line) = 1)"""
_NAMED = lambda kind, c: f"CASE WHEN repository = 'default' THEN '' ELSE repository || '::' END || '{kind}:' || {c}"
_COMPONENTS, _RELATIONS = _rows(COMPONENTS, "path, layer"), _rows(RELATIONS, "source, target, type")
_PARTS = [("src", "app"), ("src/ui", "ui")]
ORACLES = {
    # The pages' scripts import nothing, so these are the samples' cycles.
    "circular_dependencies": "SELECT 'src/data/store.ts > src/ui/view.ts' AS cycle",
    "symbol_insights": f"""WITH {_FILES}, {_FILE_LINES}, defined AS (SELECT repository, path, line_no FROM ln WHERE regexp_matches(line, '^\\s*(export\\s+)?(class|interface|function|type|const|let|var|def|struct|enum)\\s+Store\\b'))
      SELECT *, 'definition' AS kind FROM defined
      UNION ALL SELECT repository, path, line_no, 'usage' FROM ln WHERE regexp_matches(line, '\\bStore\\b') AND (repository, path, line_no) NOT IN (SELECT (repository, path, line_no) FROM defined)
      UNION ALL SELECT repository, path, line_no, 'mention' FROM ln WHERE path LIKE '%.md' AND regexp_matches(line, '\\bStore\\b')""",
    "layer_check": f"WITH {_FILES}, {_FILE_LINES}, added AS (SELECT path AS file, line_no, line FROM ln), {_VIOLATED}",
    "diff_check": rf"""WITH RECURSIVE d AS (SELECT string_split({_quoted(DIFF)}, chr(10)) AS l), each AS (SELECT i, l[i] AS line FROM d, unnest(range(1, len(l) + 1)) AS t(i)),
      walk AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS file, NULL::BIGINT AS next, ''::VARCHAR AS line, NULL::BIGINT AS line_no
        UNION ALL SELECT e.i, CASE WHEN starts_with(e.line, '+++ b/') THEN e.line[7:] ELSE file END,
          CASE WHEN starts_with(e.line, '@@') THEN regexp_extract(e.line, '\+([0-9]+)', 1)::BIGINT WHEN starts_with(e.line, 'diff ') THEN NULL WHEN starts_with(e.line, '-') THEN next ELSE next + 1 END, e.line,
          CASE WHEN starts_with(e.line, '+') AND next IS NOT NULL THEN next END FROM walk JOIN each e ON e.i = walk.i + 1),
      added AS (SELECT file, line_no, line[2:] AS line FROM walk WHERE line_no IS NOT NULL), {_VIOLATED}""",
    "component_rules": f"""WITH r AS (SELECT * FROM {_RELATIONS}), c AS (SELECT * FROM {_COMPONENTS})
      SELECT source, target, 'boundary' AS rule FROM r WHERE {_DEEP('source')} < {_DEEP('target')} AND type <> 'depends_on'
      UNION ALL SELECT source, target, 'unknown' FROM r WHERE source NOT IN (SELECT path FROM c) UNION ALL SELECT source, target, 'unknown' FROM r WHERE target NOT IN (SELECT path FROM c)
      UNION ALL SELECT source, target, 'composition' FROM r WHERE type = 'composes' AND NOT starts_with(target, source)""",
    "isolated_files": f"""WITH {_FILES}, c AS (SELECT * FROM {_rows(_PARTS, 'p, layer')}), below AS (SELECT a.p AS parent, b.p AS child FROM c a JOIN c b ON starts_with(b.p, a.p || '/'))
      SELECT DISTINCT path, parent FROM files JOIN below ON starts_with(path, parent || '/')
      WHERE NOT EXISTS (SELECT 1 FROM below b WHERE b.parent = below.parent AND starts_with(path, b.child || '/'))""",
    "large_files": r"SELECT doc_id::VARCHAR AS path, len(string_split_regex(text, '\r?\n'))::BIGINT AS n_lines FROM documents WHERE len(string_split_regex(text, '\r?\n')) > 20",
    "stream_index": "SELECT source AS repository, count(*) AS n_files, count(text) AS n_hashed FROM documents GROUP BY 1",
    "error_windows": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY 1",
    "script_declarations": f"WITH {_DECLARED} SELECT repository, path, name, kind, line FROM declared",
    "script_outline": f"WITH {_DECLARED} SELECT repository, path, string_agg('- ' || kind || ' ' || name || ' (line ' || line || ')', chr(10) ORDER BY line, name) AS outline FROM declared GROUP BY 1, 2",
    "script_graph_nodes": f"""WITH {_DECLARED} SELECT {_NAMED('file', 'path')} AS id, repository, 'file' AS type, path AS label, path AS file_path FROM scripts
      UNION ALL SELECT {_NAMED('sym', "name || '@' || path")}, repository, kind, name, path FROM declared""",
    "script_graph_edges": f"""WITH {_DECLARED} SELECT {_NAMED('file', 'path')} AS src, {_NAMED('sym', "name || '@' || path")} AS dst, 'defines' AS type, repository FROM declared""",
    "program_tokens": f"WITH {_TOKENS} SELECT file, len(w) AS n_tokens, array_to_string(w, ' ') AS tokens FROM whole",
    "program_clone_classes": f"WITH {_TOKENS} SELECT file, min(file) OVER (PARTITION BY w) AS representative FROM whole",
    "program_clones": f"""WITH {_TOKENS}, first AS (SELECT min(file) AS file, w FROM whole GROUP BY w), {_WIN('first', 30)},
      met AS (SELECT a.file AS file_a, b.file AS file_b, a.pos AS pos_a, b.pos AS pos_b FROM win a JOIN win b ON a.h = b.h AND a.file < b.file),
      nth AS (SELECT *, pos_a - row_number() OVER (PARTITION BY file_a, file_b, pos_a - pos_b ORDER BY pos_a) AS run FROM met),
      runs AS (SELECT file_a, file_b, min(pos_a) AS from_a, min(pos_b) AS from_b, count(*) + 29 AS n_tokens FROM nth GROUP BY file_a, file_b, pos_a - pos_b, run)
      SELECT file_a, file_b, a.line::BIGINT AS start_a, b.line::BIGINT AS end_a, c.line::BIGINT AS start_b, d.line::BIGINT AS end_b, n_tokens FROM runs
      JOIN kept a ON a.file = file_a AND a.pos = from_a JOIN kept b ON b.file = file_a AND b.pos = from_a + n_tokens - 1
      JOIN kept c ON c.file = file_b AND c.pos = from_b JOIN kept d ON d.file = file_b AND d.pos = from_b + n_tokens - 1""",
    "metrics_formulas": f"""WITH {_PROGRAMS}, n AS (SELECT repository, path, replace(content, chr(13) || chr(10), chr(10)) AS c FROM files),
      p AS (SELECT *, {_DECIDED.format(*map(_quoted, metrics.COMMENTS + metrics.STRINGS))} AS decided, {_DECIDED.format(*map(_quoted, metrics.STRINGS + metrics.COMMENTS[::-1]))} AS logical,
        regexp_replace(regexp_replace(c, {_quoted(metrics.COMMENTS[1])}, '', 'g'), {_quoted(metrics.COMMENTS[0])}, '', 'g') AS code,
        len(list_filter(list_transform(string_split(c, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' AND NOT regexp_matches(x, '^(//|\\*|/\\*)'))) AS n_lines FROM n),
      s AS (SELECT *, {_FOUND(metrics.IMPORTS)} AS own, {_FOUND((*metrics.IMPORTS, metrics.RESOLVED))} AS every FROM p),
      k AS (SELECT *, len(list_filter(every, lambda x: starts_with(x, '.'))) AS inside, len(list_filter(every, lambda x: NOT starts_with(x, '.') AND list_contains(string_split({_quoted(' '.join(sorted(metrics.STANDARD)))}, ' '), string_split(x, '/')[1]))) AS standard FROM s)
      SELECT repository, path, {_TENTH(f"(1 + {_N('decided', metrics.DECISIONS)} + 0.5::DOUBLE * ({_N('logical', ('&&', '[|][|]'))}))")} AS cyclomatic,
        {_TENTH(f"least(100::DOUBLE, 0.5::DOUBLE * standard + 1.5::DOUBLE * (len(every) - inside - standard) + inside + 2 * {_DEPTH.format('every')})")} AS dependencies,
        CASE WHEN len(own) = 0 THEN 0::DOUBLE ELSE {_TENTH(f"least(100::DOUBLE, CASE WHEN n_lines > 0 THEN least(40::DOUBLE, 200 * len(own) / n_lines::DOUBLE) ELSE 0 END + least(30, 6 * {_DEPTH.format('own')}) + 30 * (len(list_filter(own, lambda x: NOT starts_with(x, '.'))) / len(own)::DOUBLE))")} END AS density FROM k""",
}
