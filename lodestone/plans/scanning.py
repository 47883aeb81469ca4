"""Rule scans of the corpus, their rollups, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import findings as fd
from lodestone.operators.rules import TEXT_RULES, count_matches, select
from lodestone.plans.common import CORPUS, LINES, corpus
from lodestone.schemas import SEVERITY_PENALTY, SEVERITY_WEIGHT


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_matches(corpus(spark, sf_dir), TEXT_RULES)


def _sql_findings(rules=TEXT_RULES) -> str:
    each = " UNION ALL ".join(
        f"SELECT repository, path, lang, line_no, '{r.id}' AS rule_id, '{r.category}' AS category, '{r.severity}' AS severity, len(regexp_extract_all(line, '{r.pattern}'))::BIGINT AS n FROM lines"
        for r in rules
    )
    return f"WITH {CORPUS}, {LINES}, found AS (SELECT * FROM ({each}) WHERE n > 0)"


_CASE = lambda of, c: "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in of.items()) + f" ELSE {c}::DOUBLE END"
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 WHEN 'info' THEN 3 ELSE 4 END"


def scan_findings(spark, d):
    return found(spark, d).select("path", "line_no", "rule_id", "n")


def findings_by_severity(spark, d):
    return fd.by(found(spark, d), "severity")


def findings_by_category(spark, d):
    return fd.by(found(spark, d), "category")


def severity_score(spark, d):
    return fd.severity_score(found(spark, d), "repository")


def clean_score(spark, d):
    return fd.clean_score(corpus(spark, d), found(spark, d))


def findings_cube(spark, d):
    return fd.cube(found(spark, d))


def scan_filtered(spark, d):
    """Security findings of error or worse, in the languages that have any."""
    rules = select(TEXT_RULES, categories={"security"}, severities={"critical", "error"})
    return count_matches(corpus(spark, d).where(F.col("lang").isin("en", "de")), rules).select("path", "line_no", "rule_id", "n")


def new_findings(spark, d):
    """Findings of documents with an odd id whose text line and rule no document with an even id has."""
    now = found(spark, d).withColumn("odd", F.col("path").cast("long") % 2 == 1)
    lines_of = F.col("n").cast("string")
    key = now.select("repository", "path", "line_no", "rule_id", "n", "odd", F.concat_ws(":", "rule_id", "repository", lines_of).alias("k"))
    base = key.where(~F.col("odd")).select(F.col("k").alias("k")).distinct()
    return fd.new_findings(key.where("odd"), base, ["k"]).select("path", "line_no", "rule_id", "n")


def report_rank(spark, d):
    return fd.ranked(found(spark, d), "repository", 3).select("repository", "rank", "severity", "path", "line_no", "rule_id")


def report_markdown(spark, d):
    return fd.markdown(found(spark, d))


def findings_json(spark, d):
    return fd.as_json(found(spark, d).select("path", "line_no", "rule_id", "severity", "n"))


def principle_summary(spark, d):
    """Totals, totals by severity, and whether a repository passes: no critical finding."""
    count = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{s}")
    return found(spark, d).groupBy("repository").agg(F.sum("n").cast("long").alias("total"), *map(count, SEVERITY_WEIGHT), (F.count_if(F.col("severity") == "critical") == 0).alias("passed"))


QUERIES = {
    f.__name__: f
    for f in (scan_findings, findings_by_severity, findings_by_category, severity_score, clean_score, findings_cube, scan_filtered, new_findings, report_rank, report_markdown, findings_json, principle_summary)
}

_ALL = _sql_findings()
ORACLES = {
    "scan_findings": f"{_ALL} SELECT path, line_no, rule_id, n FROM found",
    "findings_by_severity": f"{_ALL} SELECT severity, sum(n)::BIGINT AS n_findings FROM found GROUP BY 1",
    "findings_by_category": f"{_ALL} SELECT category, sum(n)::BIGINT AS n_findings FROM found GROUP BY 1",
    "severity_score": f"{_ALL} SELECT repository, floor(sum({_CASE(SEVERITY_WEIGHT, 1)} * n) / sum(n) * 10::DOUBLE + 0.5::DOUBLE) / 10::DOUBLE AS score, sum(n)::BIGINT AS n_findings FROM found GROUP BY 1",
    "clean_score": f"""{_ALL}, lost AS (SELECT repository, path, sum({_CASE(SEVERITY_PENALTY, 0.1)} * n) AS lost FROM found GROUP BY 1, 2)
      SELECT repository, path, floor(greatest(0::DOUBLE, least(1::DOUBLE, 1 - coalesce(lost, 0::DOUBLE))) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS score
      FROM corpus LEFT JOIN lost USING (repository, path)""",
    "findings_cube": f"""{_ALL} SELECT coalesce(repository, 'all') AS repository, coalesce(lang, 'all') AS lang, coalesce(severity, 'all') AS severity, sum(n)::BIGINT AS n_findings
      FROM found GROUP BY GROUPING SETS ((repository), (lang), (severity), ())""",
    "scan_filtered": f"""{_ALL} SELECT path, line_no, rule_id, n FROM found
      WHERE category = 'security' AND severity IN ('critical', 'error') AND lang IN ('en', 'de')""",
    "new_findings": f"""{_ALL}, k AS (SELECT *, rule_id || ':' || repository || ':' || n AS k, path::BIGINT % 2 = 1 AS odd FROM found)
      SELECT path, line_no, rule_id, n FROM k WHERE odd AND k NOT IN (SELECT k FROM k WHERE NOT odd)""",
    "report_rank": f"""{_ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY {_RANK}, path, line_no, rule_id) AS rank FROM found)
      SELECT repository, rank, severity, path, line_no, rule_id FROM r WHERE rank <= 3""",
    "report_markdown": f"""{_ALL}, s AS (SELECT severity AS k, sum(n) AS n FROM found GROUP BY 1), c AS (SELECT category AS k, sum(n) AS n FROM found GROUP BY 1)
      SELECT '# Findings: ' || (SELECT coalesce(sum(n), 0) FROM found) || chr(10) || chr(10)
        || '## By severity' || chr(10) || (SELECT coalesce(string_agg('| ' || k || ' | ' || n || ' |', chr(10) ORDER BY n DESC, k), 'none') FROM s) || chr(10) || chr(10)
        || '## By category' || chr(10) || (SELECT coalesce(string_agg('| ' || k || ' | ' || n || ' |', chr(10) ORDER BY n DESC, k), 'none') FROM c) AS report""",
    "findings_json": f"""{_ALL} SELECT '{{"path":"' || path || '","line_no":' || line_no || ',"rule_id":"' || rule_id || '","severity":"' || severity || '","n":' || n || '}}' AS json FROM found""",
    "principle_summary": f"""{_ALL} SELECT repository, sum(n)::BIGINT AS total, {", ".join(f"coalesce(sum(n) FILTER (severity = '{s}'), 0)::BIGINT AS n_{s}" for s in SEVERITY_WEIGHT)},
      count(*) FILTER (severity = 'critical') = 0 AS passed FROM found GROUP BY 1""",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by repository and severity beside the repository's severity score."""
    all_found = found(spark, sf_dir)
    counts = all_found.groupBy("repository", "severity").agg(F.sum("n").cast("long").alias("n_findings"))
    return counts.join(fd.severity_score(all_found, "repository").select("repository", "score"), "repository")


QUERIES["flagship"] = flagship
ORACLES["flagship"] = f"""{_ALL}, s AS ({ORACLES["severity_score"][len(_ALL):]})
  SELECT repository, severity, sum(n)::BIGINT AS n_findings, any_value(score) AS score FROM found JOIN s USING (repository) GROUP BY 1, 2"""
