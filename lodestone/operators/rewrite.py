"""Reduction and rewriting of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import half_up, token_estimate

#: What markup loses, in order: (pattern, replacement).
MARKUP = (
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"<[^>]*>", " "),
    (r"[ \t\n\r\f]+", " "),
)


def ratio(before: Column, after: Column) -> Column:
    """The part saved, rounded to 0.0001; 0 for empty texts."""
    return F.when(before > 0, half_up(1 - after / before, 4)).otherwise(F.lit(0.0))


def squeeze_markup(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, tokens_before, tokens_after, reduction, squeezed."""
    out = F.col(text)
    for pattern, new in MARKUP:
        out = F.regexp_replace(out, pattern, new)
    each = df.select(*keys, token_estimate(F.col(text)).alias("tokens_before"), F.trim(out).alias("squeezed"))
    each = each.withColumn("tokens_after", token_estimate(F.col("squeezed")))
    return each.withColumn("reduction", ratio(F.col("tokens_before"), F.col("tokens_after")))


# Code --------------------------------------------------------------------------------------------

C_LIKE = ("typescript", "javascript", "java", "go", "rust", "csharp", "css")
HASH = ("python", "bash", "powershell", "yaml")
_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
COMMENTS = {
    **{lang: re.compile(rf"({_STRINGS}|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?\*/", re.S) for lang in C_LIKE},
    **{lang: re.compile(rf"(\"\"\".*?\"\"\"|'''.*?'''|{_STRINGS})|\#[^\n]*", re.S) for lang in HASH},
    "sql": re.compile(r"('(?:''|[^'])*')|--[^\n]*|/\*.*?\*/", re.S),
    "html": re.compile(r"(\Z.)|<!--.*?-->", re.S),
    "markdown": re.compile(r"(\Z.)|<!--.*?-->", re.S),
}


def strip_comments(code: str, lang: str) -> tuple[str, int]:
    """The code without comments, which leave their line breaks, and how many there were."""
    pattern, n = COMMENTS.get(lang), 0
    if pattern is None:
        return code, 0

    def keep(m: re.Match) -> str:
        nonlocal n
        if m[1] is not None:
            return m[0]
        n += 1
        return "\n" * m[0].count("\n")

    return pattern.sub(keep, code), n


_IMPORT = {
    "python": re.compile(r"^(?:from[ \t]+\S+[ \t]+import[ \t]+(?:\([^)]*\)|[^\n]+)|import[ \t]+[^\n]+)$", re.M),
    "typescript": re.compile(r"^import\b[^;\n'\"]*(?:\{[^}]*\})?[^;\n]*?['\"][^'\"\n]+['\"];?[ \t]*$", re.M),
}
_IMPORT["javascript"] = _IMPORT["typescript"]
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
# Words that are no use of an imported name, whatever the language.
NO_NAMES = frozenset(
    "const let var function class return if else for while do switch case break continue new this super typeof instanceof void delete try catch finally throw "
    "async await yield export import from of in as true false null undefined def pass elif except raise with lambda nonlocal global print range len int str "
    "float list dict set tuple bool None True False and or not is assert self cls".split()
)


def import_names(statement: str) -> list[str]:
    """The names that an import statement binds; none for one run for its effects."""
    one = statement.strip().rstrip(";")
    if m := re.match(r"from\s+\S+\s+import\s+(.*)", one, re.S):
        return [p.split(" as ")[-1].strip() for p in m[1].strip("() \n").replace("\n", " ").split(",") if p.strip()]
    if re.match(r"import\s+['\"]", one):
        return []
    if m := re.match(r"import\s+(?:type\s+)?(.*?)\s+from\s+['\"]", one, re.S):
        head = re.sub(r"[{}]", ",", m[1])
        return [p.split(" as ")[-1].strip() for p in head.split(",") if p.strip()]
    if m := re.match(r"import\s+(.*)", one, re.S):
        return [p.split(" as ")[-1].strip().split(".")[0] for p in m[1].split(",") if p.strip()]
    return []


def whole_import(statement: str, lang: str) -> str | None:
    """The import of the whole module that stands for a statement, or null if it goes."""
    if lang == "python":
        if m := re.search(r"from\s+(\S+)\s+import\s+", statement) or re.search(r"import\s+(\w+),", statement):
            return f"import {m[1]}"
        return statement
    taken, *source = re.split(r"\s+from\s+", statement.strip().rstrip(";"))
    taken = taken.removeprefix("import").strip()
    if source and taken.startswith("{"):
        source = source[-1].strip("'\"")
        name = re.sub(r"[^\w$]", "_", source, flags=re.A)
        return f"import * as {'_' if name[:1].isdigit() else ''}{name} from '{source}';"
    return statement if source and import_names(statement) == [taken] else None


def shrink_imports(code: str, lang: str, strategy: str) -> tuple[str, int]:
    """Conservative keeps all; balanced drops those whose names occur nowhere else; aggressive makes of
    each an import of the whole module, where a rule says how, and drops or keeps the rest."""
    pattern = _IMPORT.get(lang)
    if strategy == "conservative" or pattern is None:
        return code, 0
    found = list(pattern.finditer(code))
    if strategy == "aggressive":
        whole = [whole_import(m[0], lang) for m in found]
        made = iter(whole)
        return pattern.sub(lambda m: next(made) or "", code), whole.count(None)
    body = pattern.sub("", code)
    used, n = set(_WORD.findall(body)) - NO_NAMES, 0

    def keep(m: re.Match) -> str:
        nonlocal n
        names = import_names(m[0])
        if not names or "*" in names or used.intersection(names):
            return m[0]
        n += 1
        return ""

    return pattern.sub(keep, code), n


def block_end(code: str, at: int) -> int:
    """The place after the brace that closes the one at ``at``, outside strings; the end if none does."""
    depth = 0
    for m in re.compile(rf"{_STRINGS}|[{{}}]").finditer(code, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return m.end()
    return len(code)


_FUNCTION = re.compile(r"^(?P<head>[ \t]*(?P<export>export[ \t]+)?(?:default[ \t]+)?(?:public[ \t]+|private[ \t]+|protected[ \t]+|static[ \t]+|async[ \t]+|func[ \t]+|fn[ \t]+|function[ \t]*\*?[ \t]*)*[A-Za-z_$][\w$]*[ \t]*(?:<[^>\n]*>)?\([^)]*\)[^{;\n]*)\{", re.M)
_KEYWORDS = frozenset("if for while switch catch return else do with function".split())


def strip_bodies(code: str, lang: str, private_only: bool) -> tuple[str, int]:
    """Function bodies as ``{ ... }`` (in Python ``...``), all or those of functions not exported."""
    n = 0
    if lang == "python":
        out, skip = [], None
        for line in code.split("\n"):
            indent = len(line) - len(line.lstrip())
            if skip is not None and (not line.strip() or indent > skip):
                continue
            skip = None
            out.append(line)
            m = re.match(r"[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", line)
            if m and line.rstrip().endswith(":") and (not private_only or m[1].startswith("_")):
                out.append(" " * (indent + 4) + "...")
                skip, n = indent, n + 1
        return "\n".join(out), n
    if lang not in C_LIKE or lang == "css":
        return code, 0
    out, at = [], 0
    for m in _FUNCTION.finditer(code):
        name = re.search(r"([A-Za-z_$][\w$]*)[ \t]*(?:<[^>\n]*>)?\(", m["head"])
        if m.start() < at or not name or name[1] in _KEYWORDS or private_only and m["export"]:
            continue
        end = block_end(code, m.end() - 1)
        out += [code[at : m.end() - 1], "{ ... }"]
        at, n = end, n + 1
    return "".join(out) + code[at:], n


def squeeze(code: str, lang: str, strategy: str = "balanced", include_private: bool = False) -> dict:
    """Comments out, imports shrunk, bodies stripped as the strategy says, runs of empty lines cut."""
    out, comments = strip_comments(code, lang)
    out, imports = shrink_imports(out, lang, strategy)
    bodies = 0
    if strategy != "balanced" or not include_private:
        out, bodies = strip_bodies(out, lang, strategy == "balanced")
    out = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", out, flags=re.M)).strip()
    before, after = -(-len(code) // 4), -(-len(out) // 4)
    saved = int((1 - after / before) * 10_000 + 0.5) / 10_000 if before else 0.0
    return {"squeezed": out, "tokens_before": before, "tokens_after": after, "reduction": saved, "comments": comments, "imports": imports, "bodies": bodies}


def squeeze_code(corpus: DataFrame, strategy: str = "balanced", include_private: bool = False) -> DataFrame:
    """repository, path, squeezed text, tokens before and after, reduction, and what was removed."""

    def run(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            found = pd.DataFrame([squeeze(c or "", lang, strategy, include_private) for c, lang in zip(batch["content"], batch["lang"])])
            yield pd.concat([batch[["repository", "path"]].reset_index(drop=True), found], axis=1)

    own = corpus.select("repository", "path", F.coalesce("lang", F.lit("")).alias("lang"), "content")
    return own.mapInPandas(run, "repository string, path string, squeezed string, tokens_before long, tokens_after long, reduction double, comments long, imports long, bodies long")


# Batches of edits -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Operation:
    """rename (old, new: whole words), replace (old, new: text), move (path, to), create (path, new) or
    delete (path); rename and replace touch one file if path is given, else all."""

    kind: str
    path: str | None = None
    old: str = ""
    new: str = ""
    to: str | None = None


class BatchError(ValueError):
    pass


def refactor(corpus: DataFrame, operations: list[Operation]) -> DataFrame:
    """The corpus after all operations, or BatchError and no change.  Each operation is a projection,
    filter or union; what must hold for it is checked with one count before the next."""
    files = corpus
    for i, op in enumerate(operations):
        own = F.lit(True) if op.path is None else F.col("path") == op.path
        if op.kind in ("rename", "replace"):
            pattern = rf"(?<![\w$]){re.escape(op.old)}(?![\w$])" if op.kind == "rename" else re.escape(op.old)
            hit = own & F.col("content").rlike(pattern)
            if not op.old or files.where(hit).isEmpty():
                raise BatchError(f"operation {i}: {op.old!r} is nowhere")
            new = F.regexp_replace("content", pattern, op.new.replace("\\", r"\\").replace("$", r"\$"))
            files = files.withColumn("content", F.when(own, new).otherwise(F.col("content")))
        elif op.kind in ("move", "delete"):
            if files.where(own).isEmpty():
                raise BatchError(f"operation {i}: no file {op.path}")
            if op.kind == "move":
                if not files.where(F.col("path") == op.to).isEmpty():
                    raise BatchError(f"operation {i}: {op.to} exists")
                files = files.withColumn("path", F.when(own, F.lit(op.to)).otherwise(F.col("path")))
            else:
                files = files.where(~own)
        elif op.kind == "create":
            if not files.where(own).isEmpty():
                raise BatchError(f"operation {i}: {op.path} exists")
            new = corpus.sparkSession.createDataFrame([("default", op.path, None, op.new)], "repository string, path string, lang string, content string")
            files = files.unionByName(new)
        else:
            raise BatchError(f"operation {i}: unknown kind {op.kind}")
    return files


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change: lines that one side has more often than the other; '-' and '+'."""
    count = lambda df, sign: df.groupBy(*keys, "line").agg(F.lit(sign).alias("sign"), F.count(F.lit(1)).alias("n"))
    both = count(before, -1).unionByName(count(after, 1)).groupBy(*keys, "line").agg(F.sum(F.col("sign") * F.col("n")).alias("d"))
    return both.where("d <> 0").select(*keys, "line", F.when(F.col("d") > 0, "+").otherwise("-").alias("change"), F.abs("d").cast("long").alias("n"))
