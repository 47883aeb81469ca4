"""Table schemas and the small fixed dimensions that the operators share."""

from __future__ import annotations

from pyspark.sql import types as T



CORPUS = "repository STRING, path STRING, lang STRING, content STRING"
FINDINGS = "pattern_id STRING, pattern_name STRING, file_path STRING, line BIGINT, column BIGINT, end_line BIGINT, message STRING, severity STRING, category STRING, snippet STRING"
NODES = "id STRING, repository STRING, type STRING, label STRING, file_path STRING, metadata MAP<STRING,STRING>"
EDGES = "src STRING, dst STRING, type STRING, repository STRING, metadata MAP<STRING,STRING>"
INDEXED_FILES = "file_path STRING, repository STRING, file_hash STRING, node_count BIGINT, indexed_at TIMESTAMP"
INTENTS = "id BIGINT, intent_type STRING, query_text STRING, annotation STRING, file_path STRING, created_at TIMESTAMP, updated_at TIMESTAMP, metadata_json STRING"

# Fixed values that results depend on.
SEVERITY_WEIGHT = {"critical": 10, "error": 5, "warning": 2, "info": 1}
SEVERITY_PENALTY = {"critical": 0.4, "error": 0.25, "warning": 0.15, "info": 0.05}
UNKNOWN_WEIGHT, UNKNOWN_PENALTY = 1, 0.1
SEVERITIES = ("critical", "error", "warning", "info")
CATEGORIES = ("security", "performance", "correctness", "style", "complexity", "duplication", "architecture", "best_practice")
NODE_TYPES = ("file", "class", "function", "interface", "type", "variable", "export")
EDGE_TYPES = ("defines", "imports", "calls", "extends", "implements")
DECLARATION_TYPES = ("class", "function", "interface", "type", "variable", "export")
#: Tier: highest score, label, effort.
TIERS = ((1, 15.0, "junior", "trivial"), (2, 40.0, "mid", "moderate"), (3, 80.0, "senior", "complex"), (4, None, "expert", "expert"))
EFFORT_TIME = {"trivial": "minutes", "moderate": "under an hour", "complex": "a few hours to a day", "expert": "multiple days"}
