import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import clones, extract, graph, layers, rewrite, sequences
from lodestone.operators.store import Conflict, GraphStore
from lodestone.sources import changed, directory, glob_to_regex, ignored, inline
from lodestone.streaming import current_index, idempotent


@pytest.fixture
def small(spark):
    nodes = spark.createDataFrame([(x, "default" if x != "far::z" else "far", "function", x, f"p/{x}") for x in ("a", "b", "c", "d", "e", "far::z")], "id string, repository string, type string, label string, file_path string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "calls"), ("b", "c", "imports"), ("c", "d", "calls"), ("d", "gone", "calls")], "src string, dst string, type string")
    return nodes, edges


def test_search(small):
    nodes, edges = small
    start = graph.seeds(nodes, "A", path="p/a")
    assert {r.id: r.depth for r in graph.neighbourhood(start, edges, 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.id for r in graph.neighbourhood(start, edges, 1).collect()} == {"a", "b"}
    assert graph.valid_edges(nodes, graph.distinct_edges(edges)).count() == 3
    assert {r.id: r.referrers for r in graph.references(nodes, edges, "b").collect()} == {"b": ["a"]}
    assert {r.id: r.referrers for r in graph.references(nodes, edges, "e").collect()} == {"e": []}
    assert graph.references(nodes, edges, "b", prefix="q/").count() == 0
    assert [r.id for r in graph.definitions(nodes, "z").collect()] == ["far::z"]


def test_trees_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("b", "a", "calls"), ("d", "d", "calls")], "src string, dst string, type string")
    assert sorted(r.cycle for r in graph.cycles(edges, 5).collect()) == [["a", "b"], ["a", "b", "c"], ["d"]]
    start = spark.createDataFrame([("a",)], "id string")
    paths = sorted(r.path for r in graph.call_tree(start, edges, 2).collect())
    assert paths == [["a"], ["a", "b"], ["a", "b", "a"], ["a", "b", "c"]]
    assert graph.cycles(edges.limit(0), 5).count() == 0


def test_resolution(spark):
    files = inline(spark, {"s/a.ts": "", "s/lib/index.ts": "", "b.js": "", "/abs/c.ts": ""})
    imports = spark.createDataFrame([("default", "s/x.ts", s) for s in ("./a", "./lib", "../b", "./none", "react")] + [("default", "/abs/y.ts", "./c")], "repository string, path string, source string")
    got = {(r.path, r.source): r.target for r in graph.resolve_imports(imports, files).collect()}
    assert got == {("s/x.ts", "./a"): "s/a.ts", ("s/x.ts", "./lib"): "s/lib/index.ts", ("s/x.ts", "../b"): "b.js", ("s/x.ts", "./none"): None, ("/abs/y.ts", "./c"): "/abs/c.ts"}


def test_layers(spark):
    m = layers.parse_manifest("## L\n- ui: depends on [core]\n- core: depends on []\n## C\n- src/ui: ui\n- src/ui/deep: core\n- src/core: core\n")
    assert m.layers == {"ui": ("core",), "core": ()} and m.components[1] == ("src/ui/deep", "core")
    corpus = inline(spark, {"src/ui/a.ts": "import x from '../core/b';", "src/core/b.ts": "import y from '../ui/a';\nimport z from 'lib';", "src/ui/deep/c.ts": "import q from '../a';"})
    out = {(r.file, r.line_no, r.from_layer, r.to_layer) for r in layers.check_files(corpus, m).collect()}
    assert out == {("src/core/b.ts", 1, "core", "ui")}  # the first component that fits holds
    diff = "diff --git a/src/core/b.ts b/src/core/b.ts\n--- a/src/core/b.ts\n+++ b/src/core/b.ts\n@@ -1,2 +10,3 @@\n a\n+import y from '../ui/a';\n-b\n c\n@@ -20 +30,2 @@\n+import { k } from '../ui/k';\n x\n"
    found = sorted((r.file, r.line_no) for r in layers.check_diff(spark.createDataFrame([(diff,)], "diff string"), m).collect())
    assert found == [("src/core/b.ts", 11), ("src/core/b.ts", 30)]


def test_added_text_is_no_header(spark):
    hunk = "@@ -1,2 +1,4 @@\n x\n--- y\n+++ b/other\n+z\n"
    git, bare = "diff --git a/f b/f\n--- a/f\n+++ b/f\n", "--- a/{0}\n+++ b/{0}\n"
    rows = [(1, git + hunk), (2, bare.format("f") + hunk + bare.format("g") + "@@ -1 +7,2 @@\n x\n+y\n")]
    out = layers.parse_diff(spark.createDataFrame(rows, "id int, diff string")).collect()
    f = [("f", 2, "++ b/other"), ("f", 3, "z")]
    assert sorted((r.file, r.line_no, r.content) for r in out if r.id == 1) == f
    assert sorted((r.file, r.line_no, r.content) for r in out if r.id == 2) == [*f, ("g", 8, "y")]


def test_each_row_is_a_diff_of_its_own(spark):
    one = "diff --git a/{0} b/{0}\n--- a/{0}\n+++ b/{0}\n@@ -1 +{1},2 @@\n x\n+import y from '../ui/a';\n"
    rows = [(one.format("src/core/a.ts", 3),), (one.format("src/core/b.ts", 8),), (one.format("src/core/b.ts", 8),), ("",), (None,)]
    out = layers.parse_diff(spark.createDataFrame(rows, "diff string").repartition(3)).collect()
    assert sorted((r.file, r.line_no) for r in out) == [("src/core/a.ts", 4), ("src/core/b.ts", 9), ("src/core/b.ts", 9)]
    keyed = layers.parse_diff(spark.createDataFrame([(1, rows[0][0]), (1, rows[1][0])], "id int, diff string")).collect()
    assert sorted((r.id, r.file, r.line_no) for r in keyed) == [(1, "src/core/a.ts", 4), (1, "src/core/b.ts", 9)]


def test_store(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "s"))
    none = "cast(null as map<string,string>) as metadata"
    nodes = spark.createDataFrame([("a", "r1", "file", "A", "fa"), ("b", "r1", "file", "B", "fb"), ("c", "r2", "file", "C", "fc")], "id string, repository string, type string, label string, file_path string").selectExpr("*", none)
    edges = spark.createDataFrame([("a", "b", "imports", "r1"), ("b", "c", "imports", "r1")], "src string, dst string, type string, repository string").selectExpr("*", none)
    s.insert_nodes(nodes)
    s.insert_nodes(nodes.withColumn("label", F.lit("x")))
    s.insert_edges(edges.unionByName(edges))
    assert {r.label for r in s.read("nodes").collect()} == {"A", "B", "C"} and s.read("edges").count() == 2
    s.apply_delta(nodes.where("id = 'a'").withColumn("label", F.lit("A2")), edges)
    assert s.node("a").first().label == "A2" and s.outgoing("a").count() == s.incoming("b").count() == 1
    s.update_metadata(spark.createDataFrame([("a", {"k": "v"})], "id string, metadata map<string,string>"))
    assert s.node("a").first().metadata == {"k": "v"} and s.search("a2").count() == 1
    s.remove_file("fb", "r1")
    assert s.read("edges").count() == 0 and s.read("nodes").count() == 2
    s.clear_repository("r2")
    assert [r.id for r in s.read("nodes").collect()] == ["a"]
    s.set_meta("schema_version", "2")
    s.set_meta("schema_version", "3")
    assert s.get_meta("schema_version") == "3" and s.get_meta("none") is None
    now = datetime.datetime(2024, 1, 1)
    intents = spark.createDataFrame([("note", "find x", "hello", "fa", now, now, "{}")], "intent_type string, query_text string, annotation string, file_path string, created_at timestamp, updated_at timestamp, metadata_json string")
    s.add_intents(intents)
    s.add_intents(intents)
    s.delete_intent(1)
    assert [r.id for r in s.search_intents("HELLO").collect()] == [2]
    corpus = inline(spark, {"fa": "text"})
    assert s.stale(corpus).first().status == "new"
    s.record_files(s.stale(corpus).select("file_path", "repository", "file_hash", F.lit(1).cast("long").alias("node_count"), F.current_timestamp().alias("indexed_at")))
    assert s.stale(corpus).first().status == "unchanged"
    assert [r.id for r in s.intents_of_file("fa").collect()] == [2] and s.intents_of_file("fb").count() == 0
    files = spark.createDataFrame([("default", "fa", datetime.datetime(2020, 1, 1)), ("default", "fb", datetime.datetime(2020, 1, 1)), ("r1", "fa", datetime.datetime(2020, 1, 1))], "repository string, path string, modified timestamp")
    assert [(r.repository, r.path) for r in s.unmodified(files).collect()] == [("default", "fa")]
    s.export_json(str(tmp_path / "json"))
    other = GraphStore(spark, str(tmp_path / "other"))
    other.import_json(str(tmp_path / "json"))
    assert sorted(map(str, other.read("nodes").collect())) == sorted(map(str, s.read("nodes").collect()))
    s.clear()
    assert s.read("nodes").count() == 0


def test_commits_name_all_tables_at_once(spark, tmp_path, monkeypatch):
    s = GraphStore(spark, str(tmp_path / "s"))
    none = "cast(null as map<string,string>) as metadata"
    nodes = spark.createDataFrame([("a", "r", "file", "A", "fa")], "id string, repository string, type string, label string, file_path string").selectExpr("*", none)
    edges = spark.createDataFrame([("a", "a", "imports", "r")], "src string, dst string, type string, repository string").selectExpr("*", none)
    s.apply_delta(nodes, edges)
    assert s.version == 0 and set(s.snapshot().parts) == {"nodes", "edges"}
    # Of two writers that read one version the first is taken, and the other's tables are never seen.
    late = GraphStore(spark, str(tmp_path / "s"))
    read = late.version
    s.insert_nodes(nodes.withColumn("id", F.lit("b")))
    with pytest.raises(Conflict, match="another writer"):
        late.write_all({"nodes": nodes.limit(0)}, read)
    assert s.version == 1 and {r.id for r in s.read("nodes").collect()} == {"a", "b"}
    # A method that is refused starts again from the newer version: nothing is lost.
    make, tries = s.snapshot, []

    def overtaken(*a):
        own = make(*a)
        if not tries:
            tries.append(late.insert_nodes(nodes.withColumn("id", F.lit("c"))))
        return own

    monkeypatch.setattr(s, "snapshot", overtaken)
    s.delete_nodes(nodes.select("id"))
    assert tries == [2] and s.version == 3 and {r.id for r in late.read("nodes").collect()} == {"b", "c"} and late.read("edges").count() == 0


def test_external_and_default_imports(spark):
    corpus = inline(spark, {"src/a.ts": "import D, { e } from 'left/pad';\nimport './b';\nimport F from './gone';\n", "src/b.ts": "export class B {}\n"})
    nodes, edges = graph.index(*extract.fact_tables(extract.facts(corpus)), corpus)
    assert {(r.id, r.label) for r in nodes.where("type = 'file'").collect()} == {("file:src/a.ts", "a.ts"), ("file:src/b.ts", "b.ts"), ("file:left/pad", "pad"), ("file:./gone", "gone")}
    assert {(r.src, r.dst) for r in edges.where("type = 'imports'").collect()} == {("file:src/a.ts", x) for x in ("file:left/pad", "sym:D", "file:src/b.ts", "file:./gone", "sym:F")}


def test_calls_in_both_directions(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "imports")], "src string, dst string, type string")
    start = spark.createDataFrame([("b",)], "id string")
    out = {(r.direction, tuple(r.path)) for r in graph.call_hierarchy(start, edges).collect()}
    assert out == {("incoming", ("b",)), ("incoming", ("b", "a")), ("outgoing", ("b",)), ("outgoing", ("b", "c"))}
    assert graph.call_hierarchy(start, edges, "incoming").count() == 2


def test_refactor(spark):
    corpus = inline(spark, {"a.ts": "foo(foo1, foo)", "b.ts": "$x"})
    op = rewrite.Operation
    out = rewrite.refactor(corpus, [op("rename", old="foo", new="b$r"), op("replace", "b.ts", "$x", "y\\1"), op("move", "b.ts", to="c.ts"), op("create", "d.ts", new="n"), op("delete", "d.ts")])
    assert {r.path: r.content for r in out.collect()} == {"a.ts": "b$r(foo1, b$r)", "c.ts": "y\\1"}
    with pytest.raises(rewrite.BatchError):
        rewrite.refactor(corpus, [op("rename", old="foo", new="x"), op("rename", old="nowhere", new="y")])
    for bad in (op("move", "b.ts", to="a.ts"), op("create", "a.ts"), op("delete", "z.ts"), op("odd")):
        with pytest.raises(rewrite.BatchError):
            rewrite.refactor(corpus, [bad])


def test_sequences(spark):
    rows = [(1, i, x) for i, x in enumerate("ee...ee.....e")]
    df = spark.createDataFrame(rows, "u int, t int, x string")
    out = sorted((r.first_pos, r.last_pos, r["size"]) for r in sequences.islands(df, ["u"], ["t"], F.col("x") == "e", 3, 2).collect())
    assert out == [(1, 2, 2), (6, 7, 2)]
    moves = spark.createDataFrame([(1, i, m) for i, m in enumerate([-1, 1, 1, -1, -1, -1, 1])], "u int, t int, m int")
    assert [r.depth for r in sequences.clamped_depth(moves, ["u"], ["t"], F.col("m")).orderBy("t").collect()] == [0, 1, 2, 1, 0, 0, 1]


def test_clones(spark):
    shared = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, "start " + shared), (2, "an other begin " + shared + " end"), (3, shared), (4, shared), (5, "short")], "k long, t string")
    out = sorted((r.doc_a, r.doc_b, r.start_a, r.start_b, r.n_tokens) for r in clones.token_clones(df, "k", "t").collect())
    assert out == [(1, 2, 1, 3, 40), (1, 3, 1, 0, 40), (2, 3, 3, 0, 40)]
    found = clones.lsh_pairs(clones.signatures(df, "k", "t"))
    assert (3, 4, 1.0) in {(r.doc_a, r.doc_b, r.similarity) for r in found.collect()}
    spans = spark.createDataFrame([("p", 1, 5, "a", 0.5), ("p", 4, 9, "b", 0.7), ("p", 20, 21, "a", 0.1)], "path string, start long, end long, method string, confidence double")
    assert {(r.start, r.end, r.method, r.n_merged) for r in clones.merged(spans).collect()} == {(1, 9, "both", 2), (20, 21, "a", 1)}


def test_sources(spark, tmp_path):
    for p, text in (("a.ts", "é\r\n"), ("node_modules/x.ts", "no"), ("sub/b.py", "x"), ("sub/empty.py", ""), ("c.txt", "no")):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_bytes(text.encode())
    got = {r.path: (r.lang, r.content) for r in directory(spark, str(tmp_path)).collect()}
    assert got == {"a.ts": ("typescript", "é\r\n"), "sub/b.py": ("python", "x")}
    base, head = inline(spark, {"a.ts": "1", "b.ts": "2"}), inline(spark, {"a.ts": "1", "b.ts": "3", "c.ts": "4"})
    assert {(r.path, r.base_content) for r in changed(head, base).collect()} == {("b.ts", "2"), ("c.ts", None)}
    paths = spark.createDataFrame([("a/x.log",), ("keep.log",), ("build/y",), ("z",)], "p string")
    assert [r.p for r in paths.where(~ignored(F.col("p"), ["*.log", "!keep.log", "build/"])).collect()] == ["keep.log", "z"]
    assert glob_to_regex("/a/**/b?.ts").startswith("^")


def test_streams(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, h), "a") for h in (1, 2)] + [(datetime.datetime(2024, 1, 1, 3), "b")]
    spark.createDataFrame(rows, "ts timestamp, x string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, x string").parquet(str(tmp_path / "in"))
    q = idempotent(stream, "ts", "x").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.x for r in spark.table("once").collect()) == ["a", "b"]


def test_streamed_files_become_nodes_and_edges(spark, tmp_path):
    """A second batch replaces what was known of a changed file and keeps the rest."""
    schema = "repository string, path string, lang string, content string"
    put = lambda files, n: inline(spark, files).write.parquet(str(tmp_path / "in" / n))
    store = GraphStore(spark, str(tmp_path / "store"))
    run = lambda: current_index(spark, str(tmp_path / "in" / "*"), store, str(tmp_path / "checkpoint"), schema).awaitTermination()
    put({"a.ts": "import { B } from './b';\nexport class A {}\n", "b.ts": "export class B {}\n"}, "1")
    run()
    counts = lambda: {r.file_path: r.node_count for r in store.read("indexed_files").collect()}
    ids = lambda: {r.id for r in store.read("nodes").collect()}
    assert counts() == {"a.ts": 2, "b.ts": 2} and ids() == {"file:a.ts", "file:b.ts", "sym:A@a.ts", "sym:B@b.ts"}
    put({"b.ts": "import { A } from './a';\nexport class C {}\n"}, "2")
    run()
    assert ids() == {"file:a.ts", "file:b.ts", "sym:A@a.ts", "sym:C@b.ts"}
    edges = {(r.src, r.dst, r.type) for r in store.read("edges").collect()}
    assert edges == {("file:a.ts", "file:b.ts", "imports"), ("file:b.ts", "file:a.ts", "imports"), ("file:a.ts", "sym:A@a.ts", "defines"), ("file:b.ts", "sym:C@b.ts", "defines")}
    n = store.version
    run()
    assert store.version == n


def test_components_of_long_cycles(spark):
    ring = [(f"n{i:02d}", f"n{(i + 1) % 9:02d}") for i in range(9)]
    more = [("n03", "x"), ("x", "y"), ("y", "z"), ("z", "y"), ("z", "w"), ("s", "s"), ("v", "n00"), ("y", "y"), (None, "q")]
    edges = spark.createDataFrame(ring + more, "src string, dst string")
    assert ["n%02d" % i for i in range(9)] not in [r.cycle for r in graph.cycles(edges).collect()]
    got = sorted(tuple(r) for r in graph.cycle_components(edges).collect())
    assert got == [*((a, "n00") for a, _ in sorted(ring)), ("s", "s"), ("y", "y"), ("z", "y")]
    assert graph.cycle_components(edges.limit(0)).count() == 0


def test_members_name_each_documents_representative(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, "a")], "doc_id long, text string")
    got = {r.key: r.representative for r in clones.members(df, "doc_id", "text").collect()}
    assert got == {1: 1, 3: 1, 5: 1, 2: 2, 4: None}


def test_hot_groups_meet_in_parts(spark, monkeypatch):
    """A group far over the limit gives the same pairs, in several parts."""
    monkeypatch.setattr(clones, "HOT", 4)
    each = spark.createDataFrame([(1, i, 10 * i) for i in range(30)] + [(2, 5, 1), (2, 6, 2), (3, 7, 3)], "g long, key long, pos long")
    out = clones.met_by(each, ["g"], "key", "pos").collect()
    want = {(a, b, 10 * a, 10 * b) for a in range(30) for b in range(a + 1, 30)} | {(5, 6, 1, 2)}
    assert {(r.doc_a, r.doc_b, r.pos_a, r.pos_b) for r in out} == want and len(out) == len(want)


def test_plans_are_held_against_a_corpus(spark):
    corpus = inline(spark, {"a.ts": "function loadRows(table) { read(table); }", "b.ts": "function loadRows() {}", "c.ts": "unrelated words"}, "r")
    steps = [(1, ["table"], ["loadRows"], "read"), (2, None, ["saveRows"], "write"), (3, ["table", "x", "y"], ["loadRows"], "unrelated")]
    df = spark.createDataFrame(steps, "step long, key_terms array<string>, functions_to_create array<string>, action string")
    out = {r.step: r for r in clones.analyse_plan(df, corpus).collect()}
    assert out[1].query == "table loadRows read" and out[1].risk == "high" and out[1].action == "reuse_existing"
    assert [(m.file, m.confidence) for m in out[1].matches] == [("r/a.ts", 1.0), ("r/b.ts", 0.33)]
    assert (out[2].risk, out[2].action, out[2].matches) == ("none", "proceed", None)
    assert [(m.file, m.confidence) for m in out[3].matches] == [("r/a.ts", 0.4)] and out[3].risk == "none"


def test_isolated_files_equal_a_plain_version(spark):
    parts = ["src", "src/ui", "src/ui/deep", "lib", "/abs", "/abs/in", "srcs"]
    paths = ["src/a", "src/ui/b", "src/ui/deep/c", "src/uix/d", "lib/e", "/abs/f", "/abs/in/g", "srcs/h", "top", "src", "src/a"]
    out = layers.isolation(spark.createDataFrame([(p, 1) for p in paths], "path string, n int"), spark.createDataFrame([(p,) for p in parts], "path string")).collect()
    below = {p: [c for c in parts if c.startswith(p + "/")] for p in parts}
    want = [(f, p) for f in paths for p in parts if below[p] and f.startswith(p + "/") and not any(f.startswith(c + "/") for c in below[p])]
    assert sorted((r.path, r.parent) for r in out) == sorted(want) and len(want) == 5
