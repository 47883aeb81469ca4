"""Rules over program text that need state: comments, strings, braces.  Each file is scanned once, in
Arrow batches, by plain functions of (path, language, text); what they find are findings rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators.rewrite import block_end, strip_comments

Finding = tuple  # rule, severity, category, offset, message
JS = ("typescript", "javascript")
PY = ("python",)


def blanked(text: str, lang: str) -> str:
    """The text with comments and the insides of strings as blanks; offsets and lines stay."""
    out = list(text)
    quote = r"\"\"\".*?\"\"\"|'''.*?'''|" if lang in PY else ""
    comment = r"\#[^\n]*" if lang in PY else r"//[^\n]*|/\*.*?\*/"
    pattern = re.compile(rf"({comment})|({quote}\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)", re.S)
    for m in pattern.finditer(text):
        a, b = (m.start(), m.end()) if m[1] else (m.start() + 1, m.end() - 1)
        for i in range(a, b):
            if out[i] != "\n":
                out[i] = " "
    return "".join(out)


def any_usage(text: str, clean: str) -> Iterator[Finding]:
    for m in re.finditer(r":\s*any\b|\bas\s+any\b", clean):
        yield "any-usage", "warning", "best_practice", m.start(), "the type any turns checks off"


_DECLARED = re.compile(r"^\s*(?:export\s+)?(?:const|enum|import|type|interface)\b")


def magic_numbers(text: str, clean: str) -> Iterator[Finding]:
    for line in re.finditer(r"[^\n]+", clean):
        if _DECLARED.match(line[0]):
            continue
        for m in re.finditer(r"(?<![\w.$])-?\d+(?:\.\d+)?(?![\w.])", line[0]):
            value, before = float(m[0]), line[0][: m.start()].rstrip()
            skip = value in (0, 1, -1) or "." in m[0] and abs(value) < 3 or before.endswith(("[", "(", ","))
            if not skip and not re.search(r"\.length\s*[<>=!]+$|:\s*number\s*=$", before):
                yield "magic-numbers", "info", "style", line.start() + m.start(), f"{m[0]} has no name"


def nested_callbacks(text: str, clean: str, most: int = 3) -> Iterator[Finding]:
    """Functions passed as arguments, more than ``most`` within one another; one for each line."""
    stack, pending, seen = [], False, set()
    for m in re.finditer(r"(?:function\b[^{;]*|\)\s*=>\s*|\w\s*=>\s*)\{|[{}]", clean):
        if m[0] == "}":
            if stack:
                stack.pop()
            continue
        call = m[0] != "{" and re.search(r"[(,]\s*(?:async\s*)?(?:\([^()]*)?$", clean[max(0, m.start() - 200) : m.start()]) is not None
        stack.append(call)
        if call and sum(stack) > most:
            line = clean.count("\n", 0, m.start())
            if line not in seen:
                seen.add(line)
                yield "nested-callbacks", "warning", "complexity", m.start(), f"callbacks {sum(stack)} deep"


def bare_except(text: str, clean: str) -> Iterator[Finding]:
    for m in re.finditer(r"^[ \t]*except[ \t]*:", clean, re.M):
        yield "bare-except", "error", "best_practice", m.start(), "except without a class catches everything"


def mutable_defaults(text: str, clean: str) -> Iterator[Finding]:
    for d in re.finditer(r"\bdef\s+\w+\s*\(", clean):
        depth, end = 1, d.end()
        while end < len(clean) and depth:
            depth += (clean[end] == "(") - (clean[end] == ")")
            end += 1
        for m in re.finditer(r"=\s*(?:\[\s*\]|\{\s*\}|set\(\s*\))", clean[d.end() : end]):
            yield "mutable-defaults", "error", "correctness", d.end() + m.start(), "a default that calls share"


def classes(clean: str) -> Iterator[tuple[str, int, int, str]]:
    """(name, start, end, head) of each class with braces."""
    for m in re.finditer(r"\b(?:class|interface)\s+(\w+)[^{;]*\{", clean):
        yield m[1], m.start(), block_end(clean, m.end() - 1), m[0]


_METHOD = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*(?:\*\s*)?([A-Za-z_$]\w*)\s*(?:<[^>\n]*>)?\([^)]*\)[^;{\n]*(?:\{|;|$)", re.M)
_NOT_METHODS = frozenset("if for while switch catch return new function constructor else do throw await typeof".split())


def methods(clean: str, start: int, end: int) -> list[tuple[str, int]]:
    """(name, offset) of the members of a body that open at its own depth."""
    out, body = [], clean.index("{", start) + 1
    depth, at = 0, body
    for m in _METHOD.finditer(clean, body, end):
        depth += clean.count("{", at, m.start()) - clean.count("}", at, m.start())
        at = m.start()
        if depth == 0 and m[1] not in _NOT_METHODS:
            out.append((m[1], m.start()))
    return out


def god_object(text: str, clean: str, most: int = 20) -> Iterator[Finding]:
    for name, a, b, _ in classes(clean):
        n = len(methods(clean, a, b))
        if n > most:
            yield "god-object", "warning", "architecture", a, f"{name} has {n} methods"


def python_god_object(text: str, clean: str, most: int = 20) -> Iterator[Finding]:
    for m in re.finditer(r"^([ \t]*)class\s+(\w+)[^\n]*:\s*$", clean, re.M):
        indent, n = len(m[1]), 0
        for line in clean[m.end() :].split("\n")[1:]:
            own = len(line) - len(line.lstrip())
            if line.strip() and own <= indent:
                break
            d = re.match(r"\s*(?:async\s+)?def\s+(\w+)", line)
            n += bool(d) and d[1] != "__init__"
        if n > most:
            yield "god-object", "warning", "architecture", m.start(), f"{m[2]} has {n} methods"


SECRETS = (
    r"(?i)\b(?:api[_-]?key|secret(?:[_-]?key)?|access[_-]?token|auth[_-]?token|password|passwd)\b\s*[:=]\s*[\"'][^\"'\n]{6,}[\"']",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:@/\"']+:[^\s@/\"']+@",
    r"\bAKIA[0-9A-Z]{16}\b",
)


def hardcoded_secrets(text: str, clean: str) -> Iterator[Finding]:
    for p in SECRETS:
        for m in re.finditer(p, text):
            yield "hardcoded-secrets", "critical", "security", m.start(), "a secret in the source"


def unsafe_eval(text: str, clean: str) -> Iterator[Finding]:
    for p, what in (
        (r"(?<![\w.$])eval\s*\(", "eval"),
        (r"\bnew\s+Function\s*\(", "a function made of text"),
        (r"(?<![\w.$])set(?:Timeout|Interval)\s*\(\s*[\"'`]", "a timer of text"),
        (r"(?<![\w.$])require\s*\(\s*(?![\"'`\s)])", "a module named at run time"),
        (r"\bvm\.run(?:InContext|InNewContext|InThisContext)\s*\(", "code run in a context"),
    ):
        for m in re.finditer(p, clean):
            yield "unsafe-eval", "critical", "security", m.start(), what


def python_eval(text: str, clean: str) -> Iterator[Finding]:
    for m in re.finditer(r"(?<![\w.])(?:eval|exec)\s*\(", clean):
        yield "unsafe-eval", "critical", "security", m.start(), "text run as code"


# Design rules ---------------------------------------------------------------------------------------

# What tells the concerns of a class apart, value objects, and parts left undone.
CONCERNS = {
    "database": r"db\.|\.query\(|\.find\(|\.save\(|\.update\(|\.delete\(|repository|\.insert\(|\.create\(|\.findOne\(|\.findAll\(",
    "ui": r"\.render\(|\.display\(|formatHTML|\.innerHTML|createElement|\.appendChild|document\.|window\.|\.show\(|\.alert\(|console\.log",
    "business_logic": r"calculate|compute|validate|process|transform|\.map\(|\.filter\(|\.reduce\(|\bapply\b|\brules?\b|\bpolicy\b",
    "external_service": r"fetch\(|axios|http\.|\.post\(|\.get\(|sendEmail|\.send\(|api\.|request\(|\.emit\(|publish",
    "logging": r"logger\.|log\.info|log\.error|log\.warn|console\.log|console\.error",
    "file_io": r"fs\.|readFile|writeFile|\.pipe\(|stream",
    "serialization": r"JSON\.stringify|JSON\.parse|\.toString\(|serialize|deserialize",
}
VALUE_SUFFIXES = "Dto DTO ValueObject Vo VO Data Record Model Entity Event Message Request Response Result Error Config Options Settings Props State Input Output".split()
VALUE_NAMES = "string number boolean Date RegExp Map Set Array Object Promise Error".split()
NOT_DONE = (
    r"""throw\s+(?:new\s+)?(?:NotImplementedError|Error)\s*\(\s*['"`][^'"`]*not\s+implemented[^'"`]*['"`]""",
    r"""throw\s+(?:new\s+)?(?:Error|NotImplementedError)\s*\(\s*['"`](?:TODO|stub|impl[^'"`]*|)['"`]\)""",
    r"""throw\s+(?:new\s+)?NotImplementedError\b""",
)
_NOT_DONE = re.compile("|".join(NOT_DONE), re.I)


def value_object(name: str) -> bool:
    """Whether a type carries values alone: a listed name, or one that ends in a listed word after others."""
    return name in VALUE_NAMES or any(name.endswith(x) and name != x for x in VALUE_SUFFIXES)


UTILITIES = frozenset("Math JSON Object Array Number String Date Promise console process Symbol Reflect Buffer".split())


_TYPED_MEMBER = re.compile(r"\b(?:private|public|protected|readonly)\s+\w+\s*:\s*\w")
_ABSTRACT_TYPE = re.compile(r":\s*(?:I[A-Z]|Abstract|Readonly|Partial|Pick|Omit)")
_OWN_RESULT = re.compile(r"this\.\w+\s*=|return\s+this\.")


def own_work(line: str) -> str:
    """What a line of a class does itself: nothing if it declares a typed member or hands its work to a
    part (``this.part.do(``) without keeping or returning the result; else what precedes a type by contract."""
    line = line.strip()
    handed_on = re.match(r"(?:await\s+)?this\.\w+\.", line) or (re.search(r"this\.\w+\.\w+\s*\(", line) and not _OWN_RESULT.match(line))
    return "" if handed_on or _TYPED_MEMBER.search(line) else _ABSTRACT_TYPE.split(line)[0]


def single_responsibility(text: str, clean: str, most: int = 1) -> Iterator[Finding]:
    for name, a, b, head in classes(clean):
        if head.lstrip().startswith("class"):
            done = "\n".join(map(own_work, clean[a + len(head) : b].split("\n")))
            found = sorted(c for c, p in CONCERNS.items() if re.search(p, done))
            if len(found) > most:
                yield "srp", "warning", "architecture", a, f"{name} mixes {', '.join(found)}"


def open_closed(text: str, clean: str, most: int = 3, gap: int = 3) -> Iterator[Finding]:
    for m in re.finditer(r"\bswitch\s*\([^)]*\)\s*\{", clean):
        n = len(re.findall(r"\bcase\b", clean[m.end() : block_end(clean, m.end() - 1)]))
        if n > most:
            yield "ocp-switch", "warning", "architecture", m.start(), f"a switch of {n} cases"
    lines = [(clean.count("\n", 0, m.start()), m.start()) for m in re.finditer(r"""\bif\s*\([^\n]*===?\s*(["'`])\s+\1\)""", clean)]  # the insides of strings are blanks
    island: list[tuple[int, int]] = []
    for at in [*lines, (1 << 60, 0)]:
        if island and at[0] - island[-1][0] > gap:
            if len(island) > most:
                yield "ocp-if-chain", "info", "architecture", island[0][1], f"a chain of {len(island)} conditions"
            island = []
        island.append(at)
    checks = [m.start() for m in re.finditer(r"""\bif\s*\(\s*(?:typeof\s+\w+\s*===?\s*["'`]|instanceof\b)""", clean)]
    if len(checks) > most:
        yield "ocp-type-checks", "info", "architecture", checks[0], f"{len(checks)} checks of types"


def liskov(text: str, clean: str) -> Iterator[Finding]:
    for name, a, b, head in classes(clean):
        if not re.search(r"\bextends\b", head) or head.startswith("interface"):
            continue
        for m in _NOT_DONE.finditer(text, a, b):
            yield "lsp-not-implemented", "error", "correctness", m.start(), f"{name} refuses what its parent does"
        generic = False  # the first of a class stands for all
        for n, at in methods(clean, a, b):
            brace = clean.find("{", at)
            body = clean[brace + 1 : block_end(clean, brace) - 1] if 0 <= brace < b else "x"
            if not body.strip() or re.fullmatch(r"\s*return\s*;?\s*", body):
                yield "lsp-empty", "warning", "correctness", at, f"{name}.{n} does nothing"
            elif not generic and (m := re.search(r"throw\s+new\s+Error\s*\(", body)):
                if not _NOT_DONE.search(text, brace, brace + len(body)):
                    generic = True
                    yield "lsp-generic-throw", "warning", "correctness", brace + 1 + m.start(), f"{name}.{n} throws a plain error"


def interface_segregation(text: str, clean: str, most: int = 5) -> Iterator[Finding]:
    for name, a, b, head in classes(clean):
        if head.startswith("interface"):
            n = len(re.findall(r"^[ \t]*\w+\??\s*(?:<[^>\n]*>)?\([^)]*\)\s*:", clean[a:b], re.M))
            if n > most:
                yield "isp-fat-interface", "warning", "architecture", a, f"{name} asks for {n} methods"
        elif "implements" in head and _NOT_DONE.search(text, a, b):
            yield "isp-unimplemented", "error", "architecture", a, f"{name} leaves parts of its interface out"
    for m in re.finditer(r"\btype\s+(\w+)\s*=\s*\{", clean):
        n = len(re.findall(r"\w+\??\s*(?:\([^)]*\)\s*:|:\s*\([^)]*\)\s*=>)", clean[m.end() : block_end(clean, m.end() - 1)]))
        if n > most:
            yield "isp-fat-type", "info", "architecture", m.start(), f"{m[1]} asks for {n} functions"


def dependency_inversion(text: str, clean: str) -> Iterator[Finding]:
    for name, a, b, head in classes(clean):
        if not head.startswith("class"):
            continue
        made = [(m[1], m.start()) for m in re.finditer(r"\bnew\s+([A-Z]\w*)\s*\(", clean[:b]) if m.start() >= a and not value_object(m[1])]
        for what, at in made:
            yield "dip-new", "warning", "architecture", at, f"{name} makes its own {what}"
        for m in re.finditer(r"(?<![\w.$])([A-Z]\w*)\.[a-z]\w*\s*\(", clean[:b]):
            if m.start() >= a and m[1] not in UTILITIES and m[1] != name:
                yield "dip-static", "info", "architecture", m.start(), f"{name} is bound to {m[1]}"
        taken = re.search(r"\bconstructor\s*\(([^)]*)\)", clean[a:b])
        if made and (not taken or not re.search(r":\s*(?:I[A-Z]\w*|\w*(?:Interface|Service|Repository|Port|Client|Logger))\b", taken[1])):
            yield "dip-no-injection", "info", "architecture", a, f"{name} takes none of its parts"


CODE_RULES: dict[str, tuple[tuple[str, ...], tuple[Callable, ...]]] = {
    "typescript": (("typescript",), (any_usage,)),
    "js": (JS, (magic_numbers, nested_callbacks, god_object, unsafe_eval, hardcoded_secrets)),
    "python": (PY, (bare_except, mutable_defaults, python_god_object, python_eval, hardcoded_secrets)),
}
DESIGN_RULES: dict[str, tuple[tuple[str, ...], tuple[Callable, ...]]] = {
    "js": (JS, (single_responsibility, open_closed, liskov, interface_segregation, dependency_inversion)),
}


def findings(path: str, lang: str, text: str, rules=CODE_RULES) -> list[tuple]:
    """Rows of the findings schema, in the order of lines."""
    out, clean, lines = set(), None, text.split("\n")
    for langs, functions in rules.values():
        if lang in langs:
            clean = blanked(text, lang) if clean is None else clean
            for f in functions:
                for rule, severity, category, at, message in f(text, clean):
                    line = text.count("\n", 0, at)
                    out.add((rule, rule, path, line + 1, at - (text.rfind("\n", 0, at) + 1) + 1, line + 1, message, severity, category, lines[line].strip()[:100]))
    return sorted(out, key=lambda r: (r[3], r[4], r[0]))


def scan(corpus: DataFrame, rules=CODE_RULES) -> DataFrame:
    names = [c.split()[0] for c in schemas.FINDINGS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            rows = [r for p, lang, c in zip(batch["path"], batch["lang"], batch["content"]) for r in findings(p, lang, c, rules)]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    langs = sorted({x for own, _ in rules.values() for x in own})
    own = corpus.where(F.col("lang").isin(*langs) & F.col("content").isNotNull()).select("path", "lang", "content")
    return own.mapInPandas(run, schemas.FINDINGS)


def strict(code: str, lang: str) -> str:
    """The code without comments and strings' contents, for counting."""
    return blanked(strip_comments(code, lang)[0], lang)
