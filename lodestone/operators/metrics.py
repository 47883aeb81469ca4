"""Metrics of program text, and their weighted total."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.code import strict

# Fixed values.
WEIGHTS = {
    "analyze": {"cyclomatic": 0.40, "dependencies": 0.25, "interface-surface": 0.20, "loc-impact": 0.10, "density": 0.05},
    "route": {"cyclomatic": 0.40, "loc-impact": 0.25, "density": 0.15, "dependencies": 0.12, "interface-surface": 0.08},
}
STANDARD = frozenset(
    "assert async_hooks buffer child_process cluster console constants crypto dgram dns domain events fs http http2 https inspector module net os path "
    "perf_hooks process punycode querystring readline repl stream string_decoder timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()
)
COMMENTS = (r"/\*[\s\S]*?\*/", r"//[^\n]*")
STRINGS = (r"'[^\n]*?'", r'"[^\n]*?"', r"`[\s\S]*?`")
DECISIONS = (r"\bif\s*\(", r"\bwhile\s*\(", r"\bfor\s*\(", r"\bswitch\s*\(", r"\bcase\s+", r"\bdefault\s*:", r"\bcatch\s*\(", r"\?\s*[^:;)]+?\s*:")
IMPORTS = (
    r"import\s+(?:(?:\{[^}]*\}|\*\s+as\s+\w+|\w+(?:\s*,\s*(?:\{[^}]*\}|\*\s+as\s+\w+))?)\s+from\s+)?['\"]([^'\"]+)['\"]",
    r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
)
RESOLVED = r"require\.resolve\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
FUNCTION_HEAD = r"\b(?:function\s+\w+|(?:async\s+)?\w+\s*=\s*(?:async\s*)?\(|^\s*(?:export\s+)?(?:async\s+)?(?:function\s+)?\w+\s*\()"
_HEAD = re.compile(FUNCTION_HEAD, re.A | re.M)
NO_HEADS = ("if ", "while ", "for ", "switch ", "catch ", "return ")


def tenth(x: float) -> float:
    return math.floor(x * 10 + 0.5) / 10


def without(code: str, patterns: tuple[str, ...]) -> str:
    for p in patterns:
        code = re.sub(p, "", code, flags=re.A)
    return code


def cyclomatic(code: str, lang: str, path: str) -> float:
    """One, one for each decision and half for each logical operator, in any language."""
    code = code.replace("\r\n", "\n")
    decided = without(code, COMMENTS + STRINGS)
    logical = without(code, STRINGS + COMMENTS[::-1])  # here the strings go first
    return tenth(1 + sum(len(re.findall(p, decided, re.A)) for p in DECISIONS) + 0.5 * (logical.count("&&") + logical.count("||")))


def sources(code: str, patterns: tuple[str, ...] = IMPORTS) -> list[str]:
    """What is imported or required, in any language, once for each time; comments go, lines first."""
    own = without(code.replace("\r\n", "\n"), COMMENTS[::-1])
    return [s for p in patterns for s in re.findall(p, own, re.A)]


def depth(found: list[str]) -> int:
    """The most steps up of relative sources; one that begins here counts a step."""
    return max((s.count("../") + s.startswith("./") for s in found if s.startswith(".")), default=0)


def dependencies(code: str, lang: str, path: str) -> float:
    s = sources(code, (*IMPORTS, RESOLVED))
    internal = sum(x.startswith(".") for x in s)
    standard = sum(not x.startswith(".") and x.split("/")[0] in STANDARD for x in s)
    return tenth(min(100.0, 0.5 * standard + 1.5 * (len(s) - internal - standard) + internal + 2 * depth(s)))


def logical_lines(code: str) -> int:
    """Lines that are neither blank nor begin as a comment."""
    return sum(bool(x) and not x.startswith(("//", "*", "/*")) for x in map(str.strip, code.split("\n")))


_FUNCTIONS = re.compile(r"\bfunction\s*\*?\s*\w*\s*\(([^)]*)\)|\b(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\(([^)]*)\)\s*(?::[^=\n]+)?=>|\bdef\s+\w+\s*\(([^)]*)\)")


def interface_surface(code: str, lang: str, path: str) -> float:
    c = strict(code, lang)
    functions = list(_FUNCTIONS.finditer(c))
    params = sum(len([p for p in (m[1] or m[2] or m[3] or "").split(",") if p.strip() and p.strip() not in ("self", "cls")]) for m in functions)
    kinds = len(re.findall(r"\bclass\s+\w", c))
    types = len(re.findall(r"\b(?:interface|type|enum)\s+\w", c))
    members = len(re.findall(r"^[ \t]+(?:(?:public|private|protected|static|async)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)\w+\s*\([^)]*\)\s*(?::[^{\n]+)?\{", c, re.M))
    return min(100.0, tenth(2 * len(functions) + 3 * kinds + types + 1.5 * members + 0.5 * params))


def brace_pairs(code: str) -> np.ndarray:
    """(place of the opening brace, place of its closing one), by the latter: braces of one depth, in
    order, are pairs.  The depth is a running sum that is never below zero, so a closing brace too many
    is none's."""
    text = np.frombuffer(code.encode("utf-32-le"), dtype="<u4")
    at = np.flatnonzero((text == ord("{")) | (text == ord("}")))
    opens = text[at] == ord("{")
    total = np.cumsum(np.where(opens, 1, -1))
    depth = total - np.minimum(0, np.minimum.accumulate(total)) if len(total) else total
    # A closing brace leaves the depth that its opening one came to, one too many leaves 0 and was at 0.
    level = np.where(opens, depth, depth + 1)
    spare = ~opens & (np.diff(depth, prepend=0) == 0)
    at, opens, level = at[~spare], opens[~spare], level[~spare]
    order = np.argsort(level, kind="stable")
    at, opens, level = at[order], opens[order], level[order]
    first = np.flatnonzero(opens[:-1] & ~opens[1:] & (level[:-1] == level[1:]))
    pairs = np.stack([at[first], at[first + 1]], axis=1)
    return pairs[np.argsort(pairs[:, 1])]


def function_sizes(code: str) -> list[int]:
    """Lines of each pair of braces that opens where a function begins, or on the line after."""
    begins = np.array([
        not line.startswith(("//", "*", "/*")) and any(not m[0].startswith(NO_HEADS) for m in _HEAD.finditer(line))
        for line in map(str.strip, code.split("\n"))
    ])
    begins |= np.roll(begins, 1) & (np.arange(len(begins)) > 0)
    breaks = [m.start() for m in re.finditer("\n", code)]
    first, last = np.searchsorted(breaks, brace_pairs(code)).T
    return (last - first + 1)[begins[first]].tolist()


def loc_impact(code: str, lang: str, path: str) -> float:
    code = code.replace("\r\n", "\n")
    n = logical_lines(code)
    sizes = function_sizes(code) or [n]
    category = 10 if n > 500 else 7 if n > 200 else 4 if n > 80 else 0
    return tenth(min(100.0, min(40, n / 2) + min(25, sum(sizes) / len(sizes) / 2) + min(25, max(sizes) / 8) + category))


def density(code: str, lang: str, path: str) -> float:
    n, s = logical_lines(code.replace("\r\n", "\n")), sources(code)
    if not s:
        return 0.0
    external = sum(not x.startswith(".") for x in s) / len(s)
    return tenth(min(100.0, (min(40, 200 * len(s) / n) if n else 0) + min(30, 6 * depth(s)) + 30 * external))


METRICS: dict[str, Callable[[str, str, str], float]] = {"cyclomatic": cyclomatic, "dependencies": dependencies, "interface-surface": interface_surface, "loc-impact": loc_impact, "density": density}


class Registry:
    """Metrics by name with their weights; one that fails scores 0."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.metrics, self.weights = dict(METRICS), dict(weights or WEIGHTS["analyze"])

    def register(self, name: str, metric: Callable[[str, str, str], float], weight: float) -> None:
        self.metrics[name], self.weights[name] = metric, weight

    def unregister(self, name: str) -> None:
        self.metrics.pop(name, None)
        self.weights.pop(name, None)

    def scores(self, code: str, lang: str, path: str) -> dict[str, float]:
        out = {}
        for name, metric in self.metrics.items():
            try:
                out[name] = float(metric(code, lang, path))
            except ImportError:
                raise
            except Exception:  # noqa: BLE001  a caller's metric may fail in any way
                out[name] = 0.0
        return out

    def total(self, scores: dict[str, float]) -> float:
        w = sum(self.weights.get(n, 0.0) for n in scores)
        return tenth(sum(s * self.weights.get(n, 0.0) for n, s in scores.items()) / w) if w else 0.0

    def strictest(self, scores: dict[str, float]) -> float:
        return max(scores.get(n, 0.0) for n in ("cyclomatic", "dependencies", "interface-surface"))


def measure(corpus: DataFrame, registry: Registry | None = None) -> DataFrame:
    """repository, path, scores (name -> score), total, strict."""
    own = registry or Registry()

    def run(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            scores = [own.scores(c, lang, p) for c, lang, p in zip(batch["content"], batch["lang"], batch["path"])]
            yield batch[["repository", "path"]].assign(scores=scores, total=[own.total(s) for s in scores], strict=[own.strictest(s) for s in scores])

    files = corpus.select("repository", "path", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("content", F.lit("")).alias("content"))
    return files.mapInPandas(run, "repository string, path string, scores map<string,double>, total double, strict double")
