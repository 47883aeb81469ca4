import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone import api
from lodestone.operators import code, extract, findings, metrics, programs, rewrite, rules, store
from lodestone.sources import inline

BAD = {
    "any-usage": ("typescript", "let a: any = b;"),
    "magic-numbers": ("javascript", "retry = wait * 77;"),
    "nested-callbacks": ("javascript", "a(function () { b(function () { c(function () { d(function () { e(); }); }); }); });"),
    "bare-except": ("python", "try:\n    f()\nexcept:\n    pass\n"),
    "mutable-defaults": ("python", "def f(\n    a,\n    b=[],\n):\n    pass\n"),
    "god-object": ("typescript", "class Big {\n" + "".join(f"  m{i}() {{ return; }}\n" for i in range(21)) + "}\n"),
    "hardcoded-secrets": ("javascript", "const apiKey = 'abcdef1234';"),
    "unsafe-eval": ("javascript", "x = eval(y);"),
    "srp": ("typescript", "class A {\n  f() { this.query('q'); console.log('x'); }\n}"),
    "ocp-switch": ("typescript", "switch (x) { case 1: case 2: case 3: case 4: break; }"),
    "ocp-if-chain": ("typescript", "if (a === 'w') f();\nif (a == 'x') f();\nelse if (b && a === \"y\") f();\nif (a === `z`) f();\n"),
    "ocp-type-checks": ("typescript", "\n\n\n\n\n".join("if (typeof x === 'a') f();" for _ in range(4))),
    "lsp-not-implemented": ("typescript", "class A extends B {\n  f() { throw new Error('not implemented'); }\n}"),
    "lsp-empty": ("typescript", "class A extends B {\n  f(): void {}\n}"),
    "lsp-generic-throw": ("typescript", "class A extends B {\n  f(): void { g(); throw new Error('bad'); }\n}"),
    "isp-fat-interface": ("typescript", "interface W {\n" + "".join(f"  m{i}(): void;\n" for i in range(6)) + "}"),
    "isp-unimplemented": ("typescript", "class A implements W {\n  f() { throw new Error('not implemented'); }\n}"),
    "isp-fat-type": ("typescript", "type W = {\n" + "".join(f"  m{i}: () => void;\n" for i in range(6)) + "}"),
    "dip-new": ("typescript", "class A {\n  f() { return new Database(); }\n}"),
    "dip-static": ("typescript", "class A {\n  f() { return Store.load(); }\n}"),
    "dip-no-injection": ("typescript", "class A {\n  constructor() { this.d = new Database(); }\n}"),
}
CLEAN = {
    "typescript": "// : any and eval(x)\nexport class Cart {\n  constructor(private readonly store: StoreService) {}\n  total(items: number[]): number { return items.length; }\n}\nconst LIMIT = 50;\n",
    "python": '"""except: and eval(x)"""\ndef f(a=None):\n    try:\n        g()\n    except ValueError:\n        pass\n',
}


def matches(lang, text):
    return [f for r in (code.CODE_RULES, code.DESIGN_RULES) for f in code.findings("f", lang, text, r)]


@pytest.mark.parametrize("rule", BAD)
def test_violations(rule):
    assert rule in {f[0] for f in matches(*BAD[rule])}


@pytest.mark.parametrize("lang", CLEAN)
def test_clean_texts(lang):
    assert matches(lang, CLEAN[lang]) == []


def test_lines_and_columns_are_exact():
    f = code.findings("f", "javascript", "ok();\n  x = eval(y); // eval(z)\n")
    assert [(x[0], x[3], x[4]) for x in f] == [("unsafe-eval", 2, 7)]


PACK_TEXTS = {
    "typescript": ("import D, { a as b } from './x';\nexport class A extends B implements C {}\n", [("./x", ("D", "b"))], {("A", "class")}, {("A", "B", "extends"), ("A", "C", "implements")}),
    "python": ("from m.n import x as y\nclass A(B, object):\n    def f(self): pass\n", [("m.n", ("y",))], {("A", "class"), ("f", "function")}, {("A", "B", "extends")}),
    "go": ('import "fmt"\ntype A struct {\n\tB\n}\nfunc (a A) Run() {}\n', [("fmt", ())], {("A", "class"), ("Run", "function")}, {("A", "B", "extends")}),
    "java": ("import a.b.C;\npublic class A extends B implements D {\n  public void run() {}\n}\n", [("a.b.C", ())], {("A", "class"), ("run", "function")}, {("A", "B", "extends"), ("A", "D", "implements")}),
    "csharp": ("using System.Text;\nusing X = Sys.Text;\npublic class A : B, IC {\n  public void Run() {}\n}\n", [("System.Text", ()), ("Sys.Text", ("X",))], {("A", "class"), ("Run", "function")}, {("A", "B", "extends"), ("A", "IC", "implements")}),
    "vbnet": ("Imports System\nImports X = Sys.Text\nPublic Class A\n  Inherits B\n  Public Sub Run()\n", [("System", ()), ("Sys.Text", ("X",))], {("A", "class"), ("Run", "function")}, {("A", "B", "extends")}),
    "rust": ("use std::io::{Read, Write};\nstruct A;\nimpl T for A {\n  fn run() {}\n}\n", [("std::io", ("Read", "Write"))], {("A", "class"), ("run", "function")}, {("A", "T", "implements")}),
    "sql": ("CREATE TABLE a (id INT REFERENCES b);\nCREATE INDEX i ON a (id);\n", [], {("a", "class"), ("i", "variable")}, {("a", "b", "extends")}),
    "bash": ("source ./env.sh\nmain() {\n  prepare\n}\n", [("./env.sh", ())], {("main", "function")}, {("main", "prepare", "calls")}),
    "powershell": ("Import-Module M\nfunction Run-It {\n  Get-Thing\n}\n", [("M", ())], {("Run-It", "function")}, {("Run-It", "Get-Thing", "calls")}),
    "rpg": ("/copy lib,a\ndcl-proc run;\n  callp other();\nend-proc;\n", [("lib,a", ())], {("run", "function")}, {("run", "other", "calls")}),
    "cobol": ("       PROGRAM-ID. PROG.\n       COPY BOOK.\n       MAIN-P.\n           PERFORM OTHER-P.\n", [("BOOK", ())], {("PROG", "class"), ("MAIN-P", "function")}, {("MAIN-P", "OTHER-P", "calls")}),
}


@pytest.mark.parametrize("lang", PACK_TEXTS)
def test_facts(lang):
    text, imports, declared, related = PACK_TEXTS[lang]
    assert extract.imports(text, lang) == imports
    assert {(n, k) for n, k, _, _ in extract.declarations(text, lang)} == declared
    assert set(extract.relationships(text, lang)) == related


def test_metrics():
    text = "function f(a, b) {\n  if (a && b) { return a ? 1 : 2; }\n  // if (\n  for (;;) {}\n}\n"
    r = metrics.Registry()
    s = r.scores(text, "javascript", "f.js")
    assert s["cyclomatic"] == 1 + 3 + 0.5 and s["interface-surface"] == 3.0 and s["dependencies"] == 0
    r.register("broken", lambda *_: 1 / 0, 1.0)
    assert r.scores(text, "javascript", "f")["broken"] == 0.0
    r.unregister("broken")
    assert r.total({"cyclomatic": 10.0, "dependencies": 10.0}) == 10.0


def test_decisions():
    """Labels need their colon, strings and comments don't count, and other languages are read alike."""
    score = lambda c: metrics.cyclomatic(c, "typescript", "f")
    assert score("export default x;") == 1 and score("switch (x) { case 1: f(); default: g(); }") == 4
    assert score("if (a) {} else if (b) {} while (c) {} do {} while (d); try {} catch (e) {}") == 6
    assert score("s = 'if (a)'; /* while (b) */ // for (c)\n") == 1 and score("if x:\n  pass\nelif y:\n  pass\n") == 1
    assert score("a = b || c && '&&';") == 2.0 and score("a = b ? c : d;") == 2


def test_dependencies_and_density():
    of = lambda c: metrics.dependencies(c, "javascript", "f")
    assert of("import a from 'fs';\nimport b from 'left';\nimport c from '../x/y';\n") == 0.5 + 1.5 + 1 + 2 * 1
    assert of("import '../../x';\nimport './y/z/w';\n") == 2 + 2 * 2 and of("import x from './a';") == 1 + 2
    assert of("const a = require('os'); const b = require.resolve('left'); import('node:fs');") == 0.5 + 1.5 + 1.5
    assert of("// import a from 'left'\n/* require('x') */") == 0
    dense = lambda c: metrics.density(c, "javascript", "f")
    lines = "x = 1;\n" * 98
    assert dense("import a from 'left';\nimport b from '../../b';\n" + lines) == min(40, 2 / 100 * 100 / 20 * 40) + 12 + 15
    assert dense("import a from 'left';") == 40 + 30 and dense(lines) == 0


def test_loc_impact():
    of = lambda c: metrics.loc_impact(c, "typescript", "f")
    assert of("word\n" * 80) == 40 + 25 + 10 and of("word\n" * 81) == 40 + 25 + 10.1 + 4
    assert of("// only\n* a\n/* comment\n\n") == 0
    # Two functions of 3 and 5 lines, whose braces open on and after their heads; a loop's don't count.
    text = "function a() {\n  x;\n}\nasync b(\n)\nc = (\n{\n  for (;;) { y; }\n  z;\n}\n"
    sizes = metrics.function_sizes(text)
    assert sizes == [3, 4] and of(text) == metrics.tenth(10 / 2 + 3.5 / 2 + 4 / 8)


def test_columns_of_equal_matches(spark):
    corpus = inline(spark, {"a.txt": "foo, foo foofoo\nno\nfoo"})
    out = rules.scan(corpus, [rules.learned("p", "foo")]).collect()
    assert sorted((r.line, r.column) for r in out) == [(1, 1), (1, 6), (1, 10), (1, 13), (3, 1)]


def test_squeeze():
    text = "// c\nimport { a, b } from 'x';\nimport { z } from 'y';\nconst s = '// no';\nexport function f() {\n  return a;\n}\nfunction g() {\n  return b;\n}\n"
    out = rewrite.squeeze(text, "typescript")
    assert "'// no'" in out["squeezed"] and "import { z }" not in out["squeezed"] and "return a" in out["squeezed"] and "return b" not in out["squeezed"]
    assert (out["comments"], out["imports"], out["bodies"]) == (1, 1, 1)
    assert "return a" not in rewrite.squeeze(text, "typescript", "aggressive")["squeezed"]
    assert rewrite.strip_comments("a /* x\ny */ b", "java") == ("a \n b", 1)
    assert rewrite.squeeze("", "python")["reduction"] == 0.0


def plain_tokens(text, python=False):
    """The normalised tokens, by one character class after the other."""
    keywords, out, i = (programs.PYTHON_KEYWORDS if python else programs.KEYWORDS), [], 0
    while i < len(text):
        rest = text[i:]
        if rest.startswith("//") or python and rest[0] == "#":
            i += len(rest.split("\n")[0])
        elif rest.startswith("/*") and "*/" in rest[2:]:
            i += rest.index("*/", 2) + 2
        elif python and rest[:3] in ("\'\'\'", '"""') and rest[:3] in rest[3:]:
            out.append("L")
            i += rest.index(rest[:3], 3) + 3
        elif rest[0] in "'\"`" and rest[0] in rest[1:]:
            out.append("L")
            i += rest.index(rest[0], 1) + 1
        elif m := re.match(r"[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?n?", rest):
            out.append("L")
            i += m.end()
        elif m := re.match(r"[A-Za-z_$][A-Za-z0-9_$]*", rest):
            out.append(m[0] if m[0] in keywords else "I")
            i += m.end()
        elif m := re.match(r"[+\-*/%=<>!&|^~?:]+", rest):
            out.append("O")
            i += m.end()
        else:
            if rest[0] in "{}[]();,.":
                out.append(rest[0])
            i += 1
    return out


def test_tokens_equal_a_plain_tokenizer(spark):
    from lodestone.plans.coding import SAMPLES, TWINS

    texts = {**SAMPLES, **TWINS, "a.ts": "x = 'it' + \"/* no */\" /* a\nb */ - `t ${1}`; y=//c\n/*open 1e-5n 'q", "b.py": "s = \'\'\'# no\nx\'\'\' # yes\nreturn None", "c.js": "", "d.js": "é@\\ a"}
    out = {r.file: r.w for r in programs.tokenised(inline(spark, texts, "r")).collect()}
    assert out == {f"r/{p}": plain_tokens(t, p.endswith(".py")) for p, t in texts.items()}


def test_renamed_copies_are_clones(spark):
    from lodestone.plans.coding import TWINS

    corpus = inline(spark, {**TWINS, "lib/again.ts": TWINS["lib/totals.ts"].replace("rows", "lines").replace("10", "77")}, "r")
    assert {(r.file, r.representative) for r in programs.clone_classes(corpus).collect() if "s.ts" in r.file or "again" in r.file} == {
        ("r/lib/again.ts", "r/lib/again.ts"), ("r/lib/totals.ts", "r/lib/again.ts"), ("r/lib/scores.ts", "r/lib/scores.ts")}
    found = programs.code_clones(corpus)
    (one,) = found.collect()
    assert (one.file_a, one.start_a, one.end_a, one.file_b, one.start_b, one.end_b) == ("r/lib/again.ts", 1, 11, "r/lib/scores.ts", 1, 12)
    a, b = plain_tokens(TWINS["lib/totals.ts"]), plain_tokens(TWINS["lib/scores.ts"])
    shared = max(n for n in range(len(a)) if any(a[-n:] == b[j : j + n] for j in range(len(b))))
    assert one.n_tokens == shared >= 60
    sides = programs.clone_findings(found).collect()
    assert {(r.file_path, r.line, r.message) for r in sides} == {("r/lib/again.ts", 1, f"Clone of r/lib/scores.ts:1-12 ({shared} tokens)"), ("r/lib/scores.ts", 1, f"Clone of r/lib/again.ts:1-11 ({shared} tokens)")}
    part = spark.createDataFrame([(1, "if (a.b > 2 && a.c) { d += a.b * a.c; }"), (2, "nothing like it"), (3, None)], "id long, text string")
    hits = {(r.id, r.file, r.start_line, r.end_line) for r in programs.find_fragments(part, "id", "text", corpus).collect()}
    assert hits == {("1", "r/lib/again.ts", 6, 8), ("1", "r/lib/totals.ts", 6, 8), ("1", "r/lib/scores.ts", 7, 9)}


def test_skeletons(spark):
    from lodestone.plans.coding import TWINS

    assert programs.skeleton_of("  let a: string = 'x' +  f(1.5, b);\n\n  return `t`") == "let $ID:$TYPE = $LIT + $FN($NUM, $ID);\nreturn $LIT"
    text = "x;\nconst f = (a) => {\n  g();\n}\nclass A extends B {\n  run(x) {\n    y();\n  }\n}\nasync function h() {\n}\n"
    assert [b[:4] for b in programs.blocks_of(text)] == [("f", "lambda", 2, 4), ("h", "function", 10, 11), ("h", "function", 10, 11), ("run", "method", 6, 8), ("A", "class", 5, 9)]
    corpus = inline(spark, TWINS, "r")
    pairs = {(r.file_a, r.label_a, r.start_a, r.file_b, r.label_b, r.start_b, r.similarity) for r in programs.structural_clones(corpus).collect()}
    assert ("r/lib/scores.ts", "scores", 4, "r/lib/totals.ts", "totals", 3) in {p[:6] for p in pairs}
    assert all(p[0] < p[3] and p[6] >= 0.5 for p in pairs)
    assert programs.structural_clones(inline(spark, {"a.ts": "function f() {\n}\n", "b.ts": "function f() {\n}\n"})).count() == 0  # they say nothing


def test_fragment_patterns(spark):
    assert programs.fragment_pattern("const total = price * 2 + total2 * 3.5;\nreturn total;") == "const $ID_0 = $ID_1 * $NUM_0 + $ID_2 * $NUM_1;\nreturn $ID_0;"
    df = programs.fragment_patterns(spark.createDataFrame([("a b a",), (None,)], "t string"), "t")
    assert [r.pattern for r in df.collect()] == ["$ID_0 $ID_1 $ID_0", None]


def test_imports_of_whole_modules():
    text = "import { a, b } from './x-y';\nimport {\n  c,\n} from '9z';\nimport D from 'd';\nimport 'e';\nimport * as f from 'f';\ncall();\n"
    out, n = rewrite.shrink_imports(text, "typescript", "aggressive")
    assert out.split() == "import * as __x_y from './x-y'; import * as _9z from '9z'; import D from 'd'; call();".split() and n == 2
    out, n = rewrite.shrink_imports("from a.b import c, d\nimport e, f\nimport g\nx()\n", "python", "aggressive")
    assert out == "import a.b\nimport e\nimport g\nx()\n" and n == 0
    # A word of the language is no use of a name.
    assert rewrite.shrink_imports("import { list } from 'x';\nlist;\n", "typescript", "balanced")[1] == 1


def test_report_entries(spark, tmp_path):
    corpus = inline(spark, {"b.js": "x = eval('a');", "a.ts": "let a: any = 1;"}, "r")
    found = api.scan_patterns(corpus)
    rows = [r.text for r in findings.markdown_findings(found).orderBy("severity_rank", "file_path", "line").collect()]
    assert rows[0].startswith("- **`[") and any("`b.js:1`" in r and "eval" in r for r in rows)
    assert rows.index(next(r for r in rows if "eval" in r)) < rows.index(next(r for r in rows if "any" in r))
    counts = found.select("severity", "category").withColumn("n", F.lit(1).cast("long"))
    findings.write_markdown(found, counts, str(tmp_path / "report"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert whole.startswith("# Findings: ") and whole.index("## By severity") < whole.index("## Findings") < whole.index("eval")


def test_learned_rules(spark):
    assert rules.learned("My Rule!", "/foo/i").pattern == "(?i)foo" and rules.learned("x", "(").pattern == r"\("
    one = rules.learned("My Rule", "fo+", message="saw ${value} in ${snippet}")
    corpus = inline(spark, {"a.py": "x foo fooo\r\nno\nfoo", "b.md": "", "c.ts": "foo"})
    out = rules.scan(corpus, rules.distinct([one, one])).collect()
    assert sorted((r.file_path, r.line, r.message) for r in out) == [("a.py", 1, "saw foo in x foo fooo"), ("a.py", 1, "saw fooo in x foo fooo"), ("a.py", 3, "saw foo in foo"), ("c.ts", 1, "saw foo in foo")]
    only = rules.scan(corpus, [rules.learned("p", "foo", languages=("python",))])
    assert {r.file_path for r in only.collect()} == {"a.py"}
    assert rules.select(rules.TEXT_RULES, severities={"critical"})[0].id == "long-hex"


def test_tools(spark, tmp_path):
    from lodestone.plans.coding import SAMPLES

    corpus = inline(spark, SAMPLES)
    assert [r.cycle for r in api.circular_dependencies(corpus).collect()] == [["src/data/store.ts", "src/ui/view.ts"]]
    assert {(r.kind, r.path) for r in api.symbol_insights(corpus, "Store").collect()} >= {("definition", "src/data/store.ts"), ("mention", "README.md")}
    counts = api.index_codebase(spark, corpus, str(tmp_path / "store"))
    assert counts["indexed_files"] == len(SAMPLES) and counts["nodes"] > 10 and counts["edges"] > 5
    assert api.audit_changes(corpus, corpus).count() == 0
    assert api.scan_patterns(corpus, severities=["critical"]).count() >= 3
    best = api.find_clones(corpus, SAMPLES["src/data/store.ts"]).first()
    assert best.path == "src/data/store.ts" and best.confidence == 0.95
    assert api.estimate(spark, "fix typo").first().level == "simple"
    assert [r.title for r in api.decompose(spark, "- one\n- two").collect()] == ["one", "two"]
    assert "IStore" in api.injection_template(spark, "View", ["Store"]).first().template
    assert api.analyze(corpus).where("tier = 1").count() == len(SAMPLES)
    assert api.route_code(corpus, strict=True).count() == len(SAMPLES)
    from lodestone.plans.coding import TWINS

    twins = inline(spark, TWINS, "r")
    assert {(r.path, r.start, r.end, r.method) for r in api.blueprint_search(twins).collect()} == {("r/lib/totals.ts", 1, 11, "both"), ("r/lib/scores.ts", 1, 12, "both")}
    assert api.code_clones(twins).count() == 1 and api.structural_clones(twins).first().similarity >= api.structural_clones(twins).collect()[-1].similarity
    part = spark.createDataFrame([(1, "if (a.b > 2 && a.c) { d += a.b * a.c; }")], "id long, text string")
    assert api.batch_find_clones(twins, part, "id", "text").count() == 2
    assert {r.file_path for r in api.scan_patterns(corpus, max_files=2).collect()} <= {"README.md", "bin/start.sh"}
    assert store.GraphStore(spark, str(tmp_path / "store")).version == 0
    assert api.pattern_catalogue(spark).count() >= 6


def test_rings_of_files_of_any_length(spark):
    corpus = inline(spark, {f"src/f{i}.ts": f"import {{ x }} from './f{(i + 1) % 9}';\n" for i in range(9)})
    assert api.circular_dependencies(corpus).count() == 0
    assert sorted(tuple(r) for r in api.circular_files(corpus).collect()) == [(f"src/f{i}.ts", "src/f0.ts") for i in range(9)]


@pytest.mark.parametrize("text, rules", [
    ("if (a) f();\nif (b) f();\nif (c > 1) f();\nif (d === 1) f();\n", set()),
    ("\n\n\n\n\n".join("if (x && typeof x === 'a') f();" for _ in range(4)), set()),
    ("class A {\n  f() { return [new UserRequest(), new OrderResult(), new Map()]; }\n}", set()),
    ("class A {\n  f() { return new QueryBuilder(); }\n}", {"dip-new", "dip-no-injection"}),
    ("class A {\n  calculateTotal() { }\n  g() {\n    db.x;\n    logger.y;\n  }\n}", {"srp"}),
    ("class A {\n  f() {\n    this.store.query(1);\n    await this.log.info(2);\n    const a = this.api.fetch(3);\n  }\n}", set()),
    ("class A {\n  private repository: Repository;\n  f(x: IPolicy, rules) { }\n  g() { return compute(); }\n}", set()),
    ("class A {\n  f() {\n    this.r = this.db.query(1);\n    return this.x.map(g);\n  }\n}", {"srp"}),
])
def test_design_rules_by_their_lists(text, rules):
    assert {f[0] for f in _rules_of(text)} == rules


def test_one_generic_throw_stands_for_a_class():
    text = "class A extends B {\n  f(): void { g(); throw new Error('bad'); }\n  h(): void { g(); throw new Error('worse'); }\n}"
    assert [f[0] for f in _rules_of(text)] == ["lsp-generic-throw"]


def _rules_of(text):
    clean = code.blanked(text, "typescript")
    return [f for rule in code.DESIGN_RULES["js"][1] for f in rule(text, clean)]


def test_braces_pair_like_a_stack():
    random.seed(5)
    for _ in range(3000):
        text = "".join(random.choices("{}\nx", k=random.randint(0, 30)))
        stack, want = [], []
        for i, c in enumerate(text):
            if c == "{":
                stack.append(i)
            elif c == "}" and stack:
                want.append([stack.pop(), i])
        assert metrics.brace_pairs(text).tolist() == want, text


def test_skeletons_take_each_token_once():
    assert programs.skeleton_of("if (x) {\n\treturn `it's ${y}` + $z.then(this, 2n)\n}") == "if ($ID) {\nreturn $LIT + $z.$FN(this, $NUM)\n}"
    assert programs.skeleton_of("") == "" and programs.skeleton_of("$run( a )") == "$$FN( $ID )"
    blocks = programs.blocks_of("function f(a) {\n  const g = () => { a }\n}\n")
    assert [b[:4] for b in blocks] == [("g", "lambda", 2, 3), ("f", "function", 1, 3)]


def test_imports_of_whole_modules_of_each_form():
    whole = lambda s: rewrite.whole_import(s, "typescript")
    assert whole("import { a, b as c } from './x-1';") == "import * as __x_1 from './x-1';"
    assert whole("import {a} from '7z'") == "import * as _7z from '7z';" and whole("import {} from '$q'") == "import * as $q from '$q';"
    assert whole("import d from 'd';") == "import d from 'd';"
    assert [whole(s) for s in ("import 'x';", "import * as n from 'x'", "import d, { a } from 'x'", "import type { A } from 'x'")] == [None] * 4
