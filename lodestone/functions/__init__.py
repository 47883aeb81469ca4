"""Column expressions that several operators use; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schemas


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves up, also below zero."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def lines(df: DataFrame, text: str, line: str = "line", number: str = "line_no") -> DataFrame:
    """One row for each line, numbered from 1; all other columns stay."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("__p", line)).withColumn(number, (F.col("__p") + 1).cast("long")).drop("__p")


def words(text: Column) -> Column:
    """Words between white space, in order."""
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """A token for every four characters begun."""
    return F.ceil(F.length(text) / 4).cast("long")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def shingles(df: DataFrame, text: str, name: str = "shingles", size: int = 5) -> DataFrame:
    """df with the distinct windows of characters of a text, after white space is collapsed; empty if
    the text is shorter.  The collapsed text is a column first, as a lambda would make it anew for
    each window."""
    own = df.withColumn("__t", normalised(F.col(text)))
    runs = F.transform(F.sequence(F.lit(1), F.length("__t") - (size - 1)), lambda i: F.substring("__t", i, size))
    return own.withColumn(name, F.when(F.length("__t") >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))).drop("__t")


def fnv1a(text: Column) -> Column:
    """FNV-1a over code points, 32 bits."""
    points = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, 1)).cast("long"))
    start = F.lit(2166136261).cast("long")
    step = lambda h, c: h.bitwiseXOR(c) * F.lit(16777619).cast("long") % F.lit(4294967296).cast("long")
    return F.when(F.length(text) > 0, F.aggregate(points, start, step)).otherwise(start)


def severity_weight(severity: Column) -> Column:
    out = F.lit(float(schemas.UNKNOWN_WEIGHT))
    for name, w in schemas.SEVERITY_WEIGHT.items():
        out = F.when(severity == name, F.lit(float(w))).otherwise(out)
    return out


def severity_penalty(severity: Column) -> Column:
    out = F.lit(schemas.UNKNOWN_PENALTY)
    for name, w in schemas.SEVERITY_PENALTY.items():
        out = F.when(severity == name, F.lit(w)).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, F.lit(i)) for i, s in enumerate(schemas.SEVERITIES)], F.lit(len(schemas.SEVERITIES))).cast("long")


def tier(score: Column) -> Column:
    """1 to 4; a shared bound belongs to the lower tier."""
    out = F.lit(schemas.TIERS[-1][0])
    for number, high, _, _ in reversed(schemas.TIERS[:-1]):
        out = F.when(score <= high, F.lit(number)).otherwise(out)
    return out.cast("long")


def by_tier(score: Column, i: int) -> Column:
    out = F.lit(schemas.TIERS[-1][i])
    for row in reversed(schemas.TIERS[:-1]):
        out = F.when(score <= row[1], F.lit(row[i])).otherwise(out)
    return out


EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "java": "java", "cs": "csharp", "vb": "vbnet", "rs": "rust",
    "sql": "sql", "sh": "bash", "bash": "bash", "ps1": "powershell", "psm1": "powershell", "rpgle": "rpg", "rpg": "rpg", "cbl": "cobol",
    "cob": "cobol", "cpy": "cobol", "json": "json", "md": "markdown", "html": "html", "css": "css", "yml": "yaml", "yaml": "yaml",
}


def language(path: Column) -> Column:
    """The language that a path's extension stands for, or null."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1)))
