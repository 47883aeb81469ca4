"""Corpora: whole files as rows of (repository, path, lang, content)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import language

# What a scan reads and passes over.
EXTENSIONS = "ts tsx js jsx mjs cjs mts cts py".split()
EXCLUDED = "node_modules .git dist build coverage .next".split()
MORE_EXCLUDED = [*EXCLUDED, ".venv", "__pycache__"]


def directory(spark: SparkSession, path: str, repository: str = "default", extensions: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """All files below a path, in any store that Spark reads; names of folders in ``excluded`` are left
    out, paths are relative to the root.  Spark's readers pass over files of no bytes; nothing could
    be found in them."""
    extensions, excluded = extensions or EXTENSIONS, EXCLUDED if excluded is None else excluded
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)
    root = re.sub(r"^[a-z0-9]+:/*", "/", path.rstrip("/"))
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + re.escape(root) + "/", "")
    own = files.select(F.lit(repository).alias("repository"), relative.alias("path"), "content")
    if excluded:
        own = own.where(~F.col("path").rlike("(^|/)(" + "|".join(map(re.escape, excluded)) + ")/"))
    return own.select("repository", "path", language(F.col("path")).alias("lang"), F.decode("content", "UTF-8").alias("content"))


def design_files(files: DataFrame) -> DataFrame:
    """Script files that are neither declarations nor tests."""
    p = F.col("path")
    return files.where(p.rlike(r"\.[jt]sx?$") & ~p.rlike(r"\.(d|test|spec)\.[jt]sx?$"))


def markdown_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").endswith(".md"))


def inline(spark: SparkSession, files: dict[str, str], repository: str = "default") -> DataFrame:
    own = spark.createDataFrame([(repository, p, c) for p, c in files.items()], "repository string, path string, content string")
    return own.select("repository", "path", language(F.col("path")).alias("lang"), "content")


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CORPUS).parquet(path)


def changed(head: DataFrame, base: DataFrame) -> DataFrame:
    """Files of head whose content differs from the same path's in base, with base_content."""
    old = base.select("repository", "path", F.col("content").alias("base_content"))
    return head.join(old, ["repository", "path"], "left").where(~F.col("content").eqNullSafe(F.col("base_content")))


def glob_to_regex(pattern: str) -> str:
    """A gitignore-like pattern as a regular expression on relative paths."""
    anchored, folder = pattern.startswith("/") or "/" in pattern.rstrip("/"), pattern.endswith("/")
    out = ""
    body = pattern.strip("/")
    i = 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that fits a path doesn't begin with !."""
    out = F.lit(False)
    for p in patterns:
        if p.strip() and not p.startswith("#"):
            out = F.when(path.rlike(glob_to_regex(p.removeprefix("!"))), F.lit(not p.startswith("!"))).otherwise(out)
    return out


def scripts_of_pages(pages: DataFrame) -> DataFrame:
    """The scripts in web pages as JavaScript files."""
    blocks = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)))
    each = pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("repository"), "page_id", blocks.alias("n", "content"))
    return each.select("repository", F.concat_ws(".", F.col("page_id").cast("string"), F.col("n").cast("string"), F.lit("js")).alias("path"), F.lit("javascript").alias("lang"), "content")
