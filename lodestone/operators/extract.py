"""Facts of program text by language: imports, declarations, relationships."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

M, I, S = re.M, re.I, re.S


@dataclass(frozen=True)
class Pack:
    """imports: patterns with the source (and perhaps ``names``); declarations: (kind, pattern of the
    name); scopes: patterns of what contains the following lines; relations: (kind, pattern with
    ``target`` and perhaps ``source``), where without a source the scope is it."""

    name: str
    imports: tuple[re.Pattern, ...] = ()
    declarations: tuple[tuple[str, re.Pattern], ...] = ()
    relations: tuple[tuple[str, re.Pattern], ...] = ()
    scopes: tuple[re.Pattern, ...] = ()
    reserved: frozenset[str] = field(default_factory=frozenset)


def _d(**kinds: str) -> tuple[tuple[str, re.Pattern], ...]:
    return tuple((k.rstrip("_"), re.compile(p, M | (I if k.endswith("_") else 0))) for k, p in kinds.items())


def _c(*patterns: str, flags: int = M) -> tuple[re.Pattern, ...]:
    return tuple(re.compile(p, flags) for p in patterns)


_TS = Pack(
    "typescript",
    _c(r"^\s*import\s+(?:type\s+)?(?P<names>[^'\";]*?)\s+from\s+['\"](?P<source>[^'\"]+)['\"]", r"^\s*import\s+['\"](?P<source>[^'\"]+)['\"]", r"\brequire\(\s*['\"](?P<source>[^'\"]+)['\"]\s*\)"),
    _d(
        function=r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)",
        class_=r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)", interface=r"^\s*(?:export\s+)?interface\s+(?P<name>\w+)",
        type=r"^\s*(?:export\s+)?type\s+(?P<name>\w+)\s*(?:<[^=]*>)?\s*=", variable=r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)",
    ) + _d(class_=r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<name>\w+)"),
    (("extends", re.compile(r"\b(?:class|interface)\s+(?P<source>\w+)(?:<[^>{]*>)?\s+extends\s+(?P<target>\w+)")), ("implements", re.compile(r"\bclass\s+(?P<source>\w+)[^{]*?\bimplements\s+(?P<target>\w+(?:\s*,\s*\w+)*)"))),
)
PACKS: dict[str, Pack] = {
    "typescript": _TS,
    "javascript": _TS,
    "python": Pack(
        "python", _c(r"^\s*from\s+(?P<source>\S+)\s+import\s+(?P<names>\([^)]*\)|[^\n#]+)", r"^\s*import\s+(?P<source>[\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*)"),
        _d(class_=r"^\s*class\s+(?P<name>\w+)", function=r"^\s*(?:async\s+)?def\s+(?P<name>\w+)"),
        (("extends", re.compile(r"^\s*class\s+(?P<source>\w+)\s*\((?P<target>[^)=]*)\)", M)),), reserved=frozenset({"object"}),
    ),
    "go": Pack(
        "go", _c(r"^\s*import\s+(?:\w+\s+)?\"(?P<source>[^\"]+)\"", r"^\s*(?:\w+\s+)?\"(?P<source>[^\"\s]+)\"\s*$"),
        _d(function=r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)", class_=r"^type\s+(?P<name>\w+)\s+struct\b", interface=r"^type\s+(?P<name>\w+)\s+interface\b"),
        (("extends", re.compile(r"^[ \t]+\*?(?P<target>[A-Z]\w*)[ \t]*$", M)),), _c(r"^type\s+(?P<name>\w+)\s+struct\b"),
    ),
    "java": Pack(
        "java", _c(r"^\s*import\s+(?:static\s+)?(?P<source>[\w.*]+)\s*;"),
        _d(class_=r"\b(?:class|enum|record)\s+(?P<name>\w+)", interface=r"\binterface\s+(?P<name>\w+)", function=r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ]+\s+(?P<name>\w+)\s*\("),
        (("extends", re.compile(r"\b(?:class|interface)\s+(?P<source>\w+)(?:<[^>{]*>)?\s+extends\s+(?P<target>\w+)")), ("implements", re.compile(r"\bclass\s+(?P<source>\w+)[^{]*?\bimplements\s+(?P<target>\w+(?:\s*,\s*\w+)*)"))),
    ),
    "csharp": Pack(
        "csharp", _c(r"^\s*using\s+(?:static\s)?\s*(?P<source>[\w.]+)\s*;", r"^\s*using\s+(?P<names>@?\w+)\s*=\s*(?P<source>[\w.]+)\s*;"),
        _d(class_=r"\b(?:class|struct|record|enum)\s+(?P<name>\w+)", interface=r"\binterface\s+(?P<name>\w+)", function=r"^\s+(?:(?:public|private|protected|internal|static|virtual|override|async)\s+)+[\w<>\[\], ]+\s+(?P<name>\w+)\s*\("),
        (("inherits", re.compile(r"\b(?:class|struct|record|interface)\s+(?P<source>\w+)(?:<[^>{]*>)?\s*:\s*(?P<target>[\w<>]+(?:\s*,\s*[\w<>]+)*)")),),
    ),
    "vbnet": Pack(
        "vbnet", _c(r"^\s*Imports\s+(?P<source>[\w.]++)(?!\s*=)", r"^\s*Imports\s+(?P<names>@?\w+)\s*=\s*(?P<source>[\w.]+)", flags=M | I),
        _d(class_=r"^\s*(?:Public\s+|Private\s+|Friend\s+)?(?:Class|Structure|Module|Enum)\s+(?P<name>\w+)", interface_=r"^\s*(?:Public\s+|Private\s+|Friend\s+)?Interface\s+(?P<name>\w+)", function_=r"^\s*(?:(?:Public|Private|Protected|Friend|Shared|Overrides)\s+)*(?:Sub|Function)\s+(?P<name>\w+)"),
        (("extends", re.compile(r"^\s*Inherits\s+(?P<target>\w+)", M | I)), ("implements", re.compile(r"^\s*Implements\s+(?P<target>\w+(?:\s*,\s*\w+)*)", M | I))), _c(r"^\s*(?:Public\s+|Private\s+|Friend\s+)?(?:Class|Structure|Interface)\s+(?P<name>\w+)", flags=M | I),
    ),
    "rust": Pack(
        "rust", _c(r"^\s*(?:pub\s+)?use\s+(?P<source>[\w:]+?)(?:::\{(?P<names>[^}]*)\})?(?:\s+as\s+\w+)?\s*;"),
        _d(class_=r"\b(?:struct|enum|union)\s+(?P<name>\w+)", interface=r"\btrait\s+(?P<name>\w+)", function=r"\bfn\s+(?P<name>\w+)"),
        (("implements", re.compile(r"\bimpl(?:<[^>]*>)?\s+(?P<target>\w+)(?:<[^>]*>)?\s+for\s+(?P<source>\w+)")),),
    ),
    "sql": Pack(
        "sql", _c(r"^\s*\\ir?\s+(?P<source>\S+)", r"^\s*source\s+(?P<source>[^\s;]+)", flags=M | I),
        _d(class_=r"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|(?:materialized\s+)?view)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.]+)", function_=r"\bcreate\s+(?:or\s+replace\s+)?(?:function|procedure)\s+(?P<name>[\w.]+)", variable_=r"\bcreate\s+(?:unique\s+)?(?:index|trigger)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.]+)"),
        (("extends", re.compile(r"\b(?:references|from|join|into)\s+(?P<target>[a-z_][\w.]*)", I)),), _c(r"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|(?:materialized\s+)?view|function|procedure)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.]+)", flags=M | I),
    ),
    "bash": Pack(
        "bash", _c(r"^\s*(?:source|\.)\s+[\"']?(?P<source>[^\s\"';]+)"), _d(function=r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{?|^\s*function\s+(?P<name2>[\w-]+)"),
        (("calls", re.compile(r"^[ \t]+(?P<target>[A-Za-z_][\w-]*)\b(?![ \t]*[=(])", M)),), _c(r"^(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{?", r"^function\s+(?P<name>[\w-]+)"),
    ),
    "powershell": Pack(
        "powershell", _c(r"^\s*Import-Module\s+(?P<source>\S+)", r"^\s*\.\s+(?P<source>\S+\.ps1)", flags=M | I), _d(function_=r"^\s*function\s+(?P<name>[\w-]+)"),
        (("calls", re.compile(r"^[ \t]+(?P<target>[A-Za-z]+-[A-Za-z]\w*)", M)),), _c(r"^\s*function\s+(?P<name>[\w-]+)", flags=M | I),
    ),
    "rpg": Pack(
        "rpg", _c(r"^\s*/(?:copy|include)\s+(?P<source>\S+)", flags=M | I), _d(function_=r"^\s*dcl-proc\s+(?P<name>\w+)", variable_=r"^\s*dcl-(?:s|ds|c)\s+(?P<name>\w+)"),
        (("calls", re.compile(r"\b(?:callp|exsr)\s+(?P<target>\w+)", I)),), _c(r"^\s*dcl-proc\s+(?P<name>\w+)", flags=M | I),
    ),
    "cobol": Pack(
        "cobol", _c(r"^\s*COPY\s+(?P<source>[\w-]+)", flags=M | I), _d(class_=r"\bPROGRAM-ID\.\s+(?P<name>[\w-]+)", function_=r"^[ \t]{7}(?P<name>[A-Z][\w-]*)\.\s*$"),
        (("calls", re.compile(r"\bCALL\s+['\"](?P<target>[\w-]+)['\"]|\bPERFORM\s+(?P<target2>[A-Z][\w-]*)", I)),), _c(r"\bPROGRAM-ID\.\s+(?P<name>[\w-]+)", r"^[ \t]{7}(?P<name>[A-Z][\w-]*)\.\s*$", flags=M | I),
        frozenset("PROCEDURE DIVISION SECTION UNTIL VARYING TIMES STOP GOBACK EXIT END-IF END-PERFORM".split()),
    ),
}


def register(pack: Pack, *languages: str) -> None:
    """Adds a pack, or replaces the one of these languages: the last registration holds."""
    for lang in languages or (pack.name,):
        PACKS[lang] = pack


def imports(code: str, lang: str) -> list[tuple[str, tuple[str, ...]]]:
    """(source, names), each once, in the order in which they stand."""
    pack, out = PACKS.get(lang), {}
    found = sorted((m for p in (pack.imports if pack else ()) for m in p.finditer(code)), key=lambda m: m.start())
    for m in found:
        names = re.sub(r"[{}()*\n]", " ", m.groupdict().get("names") or "")
        names = tuple(n.split(" as ")[-1].strip() for n in names.split(",") if n.strip())
        for source in m["source"].split(",") if lang == "python" and not m.groupdict().get("names") else [m["source"]]:
            out.setdefault((source.split(" as ")[0].strip(), names))
    return list(out)


_DEFAULT = re.compile(r"^\s*import\s+(?:type\s+)?(?P<name>(?!type\b)\w+)\s*(?:,[^'\";]*)?\s*from\s+['\"](?P<source>[^'\"]+)['\"]", M)


def defaults(code: str, lang: str) -> dict[str, str]:
    """source -> the name that a file gives to its default export."""
    return {m["source"]: m["name"] for m in _DEFAULT.finditer(code)} if PACKS.get(lang) is _TS else {}


def declarations(code: str, lang: str) -> list[tuple[str, str, int, bool]]:
    """(name, kind, line, exported), each name once: the first pattern that finds it holds."""
    pack, out = PACKS.get(lang), {}
    for kind, p in pack.declarations if pack else ():
        for m in p.finditer(code):
            name = next(v for k, v in m.groupdict().items() if v and k.startswith("name"))
            if name not in pack.reserved:
                at = m.start() + len(m[0]) - len(m[0].lstrip())
                out.setdefault(name, (name, kind, code.count("\n", 0, at) + 1, "export" in m[0] or lang not in ("typescript", "javascript") and not name.startswith("_")))
    return sorted(out.values(), key=lambda d: (d[2], d[0]))


def relationships(code: str, lang: str) -> list[tuple[str, str, str]]:
    """(source, target, kind), each once."""
    pack, out = PACKS.get(lang), {}
    if pack is None:
        return []
    scopes = sorted((m.start(), m["name"]) for p in pack.scopes for m in p.finditer(code))
    for kind, p in pack.relations:
        for m in p.finditer(code):
            source = m.groupdict().get("source") or next((n for at, n in reversed(scopes) if at <= m.start() and n not in pack.reserved), None)
            targets = m["target"] or m.groupdict().get("target2") or ""
            for t in re.split(r"\s*,\s*", re.sub(r"<[^>]*>", "", targets).strip()):
                t = t.split(".")[-1] if lang == "python" else t
                if source and t and t != source and t not in pack.reserved:
                    k = ("implements" if re.match(r"I[A-Z]", t) else "extends") if kind == "inherits" else kind
                    out.setdefault((source, t, k))
    return list(out)


def facts(corpus: DataFrame) -> DataFrame:
    """repository, path, fact (import, declaration or relationship), name, target, kind, line: one pass
    over each file; name is a source, a declared name or where a relationship starts; an import's target
    are its names and its kind the name of a default import."""

    def run(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            rows = []
            for r, p, lang, c in zip(batch["repository"], batch["path"], batch["lang"], batch["content"]):
                own = defaults(c, lang)
                rows += [(r, p, "import", s, ",".join(n), own.get(s), None) for s, n in imports(c, lang)]
                rows += [(r, p, "declaration", n, None, k, line) for n, k, line, _ in declarations(c, lang)]
                rows += [(r, p, "relationship", s, t, k, None) for s, t, k in relationships(c, lang)]
            if rows:
                out = pd.DataFrame(rows, columns=["repository", "path", "fact", "name", "target", "kind", "line"])
                yield out.assign(line=out["line"].astype("Int64"))

    own = corpus.where(F.col("lang").isin(*PACKS) & F.col("content").isNotNull()).select("repository", "path", "lang", "content")
    return own.mapInPandas(run, "repository string, path string, fact string, name string, target string, kind string, line long")


def fact_tables(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(imports, declarations, relationships) as the graph index takes them."""
    of = lambda f: found.where(F.col("fact") == f)
    return (
        of("import").select("repository", "path", F.col("name").alias("source"), F.col("kind").alias("default_name")),
        of("declaration").select("repository", "path", "name", "kind", "line"),
        of("relationship").select("repository", "path", F.col("name").alias("source"), "target", "kind"),
    )


def outline(found: DataFrame) -> DataFrame:
    """repository, path, outline: a bullet for each declaration, by line."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("line", "name", "kind"))), lambda d: F.concat(F.lit("- "), d.kind, F.lit(" "), d["name"], F.lit(" (line "), d.line.cast("string"), F.lit(")")))
    return found.where("fact = 'declaration'").groupBy("repository", "path").agg(F.array_join(each, "\n").alias("outline"))
