"""Rollups, scores, comparison and reports over findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import half_up, severity_penalty, severity_rank, severity_weight


def by(findings: DataFrame, column: str, n: str = "n") -> DataFrame:
    return findings.groupBy(column).agg(F.sum(n).cast("long").alias("n_findings"))


def severity_score(findings: DataFrame, *keys: str) -> DataFrame:
    """The mean weight of findings, rounded to a tenth."""
    weighted = F.sum(severity_weight(F.col("severity")) * F.col("n")) / F.sum("n")
    return findings.groupBy(*keys).agg(half_up(weighted, 1).alias("score"), F.sum("n").cast("long").alias("n_findings"))


def clean_score(corpus: DataFrame, findings: DataFrame) -> DataFrame:
    """One minus the penalties of a file's findings, within 0 and 1; files without any have 1."""
    lost = findings.groupBy("repository", "path").agg(F.sum(severity_penalty(F.col("severity")) * F.col("n")).alias("lost"))
    joined = corpus.select("repository", "path").join(lost, ["repository", "path"], "left")
    return joined.select("repository", "path", half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("lost", F.lit(0.0)))), 4).alias("score"))


def cube(findings: DataFrame) -> DataFrame:
    """Counts by repository, language and severity, and overall; the other keys are 'all'."""
    sets = []
    for key in ("repository", "lang", "severity", None):
        cols = [(F.col(k) if k == key else F.lit("all")).alias(k) for k in ("repository", "lang", "severity")]
        sets.append(F.struct(*cols))
    # Each finding row is counted under its four groups with partial aggregation, in one shuffle.
    each = findings.groupBy("repository", "lang", "severity").agg(F.sum("n").alias("n")).select(F.explode(F.array(*sets)).alias("g"), "n")
    return each.groupBy("g.repository", "g.lang", "g.severity").agg(F.sum("n").cast("long").alias("n_findings"))


def new_findings(current: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the base lacks; null keys are equal to each other."""
    cond = None
    for k in keys:
        c = current[k].eqNullSafe(base[k])
        cond = c if cond is None else cond & c
    return current.join(base, cond, "left_anti")


def ranked(findings: DataFrame, per: str, k: int) -> DataFrame:
    """The first k findings of each group by severity, path, line and rule."""
    order = Window.partitionBy(per).orderBy(severity_rank(F.col("severity")), "path", "line_no", "rule_id")
    return findings.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def markdown(findings: DataFrame) -> DataFrame:
    """One row, report: totals by severity and category.  Only the counts, a few rows, meet."""
    total = findings.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    table = lambda c: by(findings, c).agg(F.expr(f"listagg(concat('| ', {c}, ' | ', n_findings, ' |'), '\\n') WITHIN GROUP (ORDER BY n_findings DESC, {c})").alias(c))
    one, two = table("severity"), table("category")
    parts = total.select(F.lit(0).alias("o"), F.concat(F.lit("# Findings: "), F.col("n").cast("string")).alias("t"))
    parts = parts.unionByName(one.select(F.lit(1).alias("o"), F.concat(F.lit("## By severity\n"), F.coalesce("severity", F.lit("none"))).alias("t")))
    parts = parts.unionByName(two.select(F.lit(2).alias("o"), F.concat(F.lit("## By category\n"), F.coalesce("category", F.lit("none"))).alias("t")))
    return parts.agg(F.expr("listagg(t, '\\n\\n') WITHIN GROUP (ORDER BY o)").alias("report"))


def markdown_findings(findings: DataFrame) -> DataFrame:
    """severity_rank, file_path, line, text: an entry of a report for each of findings as scan gives them,
    to be read in the order of the first three.  Entries stay rows: a report of all of them has no bound."""
    place = F.when(F.coalesce("file_path", F.lit("")) != "", F.concat(F.lit("`"), F.col("file_path"), F.lit(":"), F.col("line"), F.lit("`"))).otherwise(F.concat(F.lit("line "), F.col("line")))
    head = F.concat(F.lit("- **`["), F.upper("severity"), F.lit("]`** "), place, F.lit(" \u2014 "), F.col("message"))
    snippet = F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("\n  ```\n  "), F.replace(F.col("snippet"), F.lit("`"), F.lit("\\`")), F.lit("\n  ```"))).otherwise("")
    return findings.select(severity_rank(F.col("severity")).alias("severity_rank"), "file_path", "line", F.concat(head, snippet).alias("text"))


def write_markdown(findings: DataFrame, counts: DataFrame, path: str) -> None:
    """A report as text files that, read in the order of their names, are one document: totals, then all
    findings, worst first."""
    total = markdown(counts).select(F.lit(-1).alias("severity_rank"), F.lit("").alias("file_path"), F.lit(0).cast("long").alias("line"), F.concat("report", F.lit("\n\n## Findings\n")).alias("text"))
    entries = total.unionByName(markdown_findings(findings).withColumns({"severity_rank": F.col("severity_rank").cast("int"), "line": F.col("line").cast("long")}))
    entries.orderBy("severity_rank", "file_path", "line", "text").select("text").write.text(path)


def as_json(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("json"))
