"""Declarative rules: a regular expression with an id, category, severity and languages.

All rules of one call are evaluated in a single pass over the lines, in the JVM; the rule set is a
driver-side constant, so filters on it prune before anything is planned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import lines


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    category: str
    severity: str
    pattern: str
    languages: tuple[str, ...] = ()
    message: str = "${value}"


def learned(name: str, pattern: str, category: str = "best_practice", severity: str = "warning", languages: tuple[str, ...] = (), message: str = "${value}") -> Rule:
    """A rule from a definition.  A pattern may be written /p/flags; what is no valid regular
    expression stands for its own text."""
    m = re.fullmatch(r"/(.*)/([gimsuy]*)", pattern, re.S)
    if m:
        flags = "".join(c for c in m[2] if c in "ims")
        pattern = (f"(?{flags})" if flags else "") + m[1]
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    slug = re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")
    return Rule(f"custom-{slug}", name, category, severity, pattern, tuple(languages), message)


def distinct(rules: list[Rule]) -> list[Rule]:
    """Each id once, in order; the first one holds, languages add up."""
    out: dict[str, Rule] = {}
    for r in rules:
        old = out.get(r.id)
        out[r.id] = r if old is None else replace(old, languages=tuple(dict.fromkeys(old.languages + r.languages)) if old.languages and r.languages else ())
    return list(out.values())


def select(rules: list[Rule], categories=None, severities=None, ids=None, languages=None) -> list[Rule]:
    """The rules of a catalogue that all given filters allow."""
    fits = lambda r: (
        (categories is None or r.category in categories) and (severities is None or r.severity in severities)
        and (ids is None or r.id in ids) and (languages is None or not r.languages or bool(set(r.languages) & set(languages)))
    )
    return [r for r in rules if fits(r)]


def catalogue(spark, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.id, r.name, r.category, r.severity, list(r.languages), r.pattern, r.message) for r in rules], "id STRING, name STRING, category STRING, severity STRING, languages ARRAY<STRING>, pattern STRING, message_template STRING")


def _fits(r: Rule, lang: Column) -> Column:
    return lang.isin(*r.languages) if r.languages else F.lit(True)


def count_matches(corpus: DataFrame, rules: list[Rule]) -> DataFrame:
    """repository, path, line_no, rule_id, category, severity, n: matches by line and rule."""
    each = lines(corpus.select("repository", "path", "lang", "content"), "content")
    hits = F.array(*[
        F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"),
                 F.when(_fits(r, F.col("lang")), F.regexp_count("line", F.lit(r.pattern))).otherwise(F.lit(0)).cast("long").alias("n"))
        for r in rules
    ])
    found = each.select("repository", "path", "lang", "line_no", F.explode(F.filter(hits, lambda h: h.n > 0)).alias("h"))
    return found.select("repository", "path", "lang", "line_no", "h.*")


def scan(corpus: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings: one row for each match, with line, column, filled message and snippet."""
    each = lines(corpus.select("repository", "path", "lang", "content"), "content")
    hits = []
    for r in rules:
        values = F.when(_fits(r, F.col("lang")), F.regexp_extract_all("line", F.lit(r.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        hits.append(_tagged(values, r))
    found = each.select("repository", "path", "line_no", "line", F.explode(F.concat(*hits)).alias("h"))
    return found.select(
        F.col("h.id").alias("pattern_id"), F.col("h.name").alias("pattern_name"), F.col("path").alias("file_path"), F.col("line_no").alias("line"),
        F.col("h.column").alias("column"), F.col("line_no").alias("end_line"),
        F.replace(F.replace(F.col("h.message"), F.lit("${value}"), F.col("h.value")), F.lit("${snippet}"), F.substring(F.trim("line"), 1, 100)).alias("message"),
        F.col("h.severity").alias("severity"), F.col("h.category").alias("category"), F.substring(F.trim("line"), 1, 100).alias("snippet"),
    )


def _tagged(values: Column, r: Rule) -> Column:
    """A struct for each match, with its column: the lengths of all matches before it, and of what lies
    between them, add up to where it stands."""
    each = F.zip_with(values, F.split("line", r.pattern), lambda v, gap: F.struct(F.coalesce(F.length(v), F.lit(0)).alias("n"), F.length(gap).alias("gap")))
    begin = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<bigint>").alias("columns"))
    step = lambda s, x: F.struct((s.at + x.gap + x.n).alias("at"), F.concat(s.columns, F.array(s.at + x.gap)).alias("columns"))
    columns = F.aggregate(each, begin, step, lambda s: s.columns)
    tag = lambda v, c: F.struct(F.lit(r.id).alias("id"), F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.lit(r.message).alias("message"), v.alias("value"), c.alias("column"))
    found = F.filter(F.zip_with(values, columns, tag), lambda x: x["value"].isNotNull())
    return F.when(F.size(values) > 0, found).otherwise(F.filter(found, lambda x: F.lit(False)))


#: Rules for prose and data; all patterns mean the same to Java and to RE2.
TEXT_RULES = [
    Rule("email", "Email address", "security", "error", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"),
    Rule("ipv4", "IPv4 address", "security", "warning", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"),
    Rule("long-hex", "Long hexadecimal number", "security", "critical", r"[0-9a-f]{32,}"),
    Rule("card-digits", "Digits like a card's", "correctness", "error", r"[0-9]{13,19}"),
    Rule("licence-line", "Licence line", "best_practice", "info", r"(?i)licen[cs]ed? under|copyright"),
    Rule("shouting", "Line in capitals", "style", "info", r"^[A-Z][A-Z !,.]{20,}\z"),
]
