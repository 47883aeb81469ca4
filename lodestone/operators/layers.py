"""Layer rules: manifest, diff, and checks of imports against what layers may depend on."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import lines
from lodestone.operators.graph import normal_path
from lodestone.tables import written


@dataclass(frozen=True)
class Manifest:
    """layers: name -> names it may depend on; components: (path, layer) in order."""

    layers: dict[str, tuple[str, ...]]
    components: tuple[tuple[str, str], ...]

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """allowed(from_layer, to_layer) and components(ord, path, layer); both are as small as the manifest."""
        allowed = [(a, b) for a, bs in self.layers.items() for b in bs]
        return (
            spark.createDataFrame(allowed, "from_layer string, to_layer string"),
            spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(self.components)], "ord int, path string, layer string"),
        )


def parse_manifest(text: str) -> Manifest:
    """Bullets ``name: depends on [a, b]`` are layers, bullets ``path: layer`` components."""
    layers, components = {}, []
    for line in text.splitlines():
        m = re.match(r"\s*[-*]\s+`?([^:`]+)`?\s*:\s*(.+?)\s*$", line)
        if not m:
            continue
        depends = re.match(r"depends on\s*\[(.*)\]", m[2], re.I)
        if depends:
            layers[m[1].strip()] = tuple(x.strip() for x in depends[1].split(",") if x.strip())
        else:
            components.append((m[1].strip(), m[2].strip("` ")))
    return Manifest(layers, tuple(components))


def parse_diff(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """file, line_no, content, and the diffs' other columns: the lines that unified diffs add, by line of
    the new file.  Each row is a diff of its own, whether or not others are equal; rows are numbered in
    a written table, and each is one group.  Files are named by ``diff --git`` lines; only before the first of
    these does a pair of ``---`` and ``+++`` lines that a hunk follows name one, so added text like ``++ b/x`` is text."""
    key = [c for c in diffs.columns if c != text]
    each = lines(written(diffs.withColumn("__diff", F.monotonically_increasing_id())), text, number="n")
    row, line = Window.partitionBy("__diff").orderBy("n"), F.col("line")
    w = row.rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns({"git": F.max(line.startswith("diff --git ")).over(w), "above": F.lag("line").over(row), "below": F.lead("line").over(row)})
    plain = ~F.col("git") & line.startswith("+++ b/") & F.col("above").startswith("--- ") & F.col("below").startswith("@@")
    name = F.when(line.startswith("diff --git "), F.regexp_extract("line", r" b/(.*)$", 1)).when(plain, F.substring("line", 7, 1 << 30))
    each = each.withColumns({
        "file": F.last(name, True).over(w),
        "hunk": F.last(F.when(line.startswith("@@"), F.col("n")), True).over(w),
        "head": F.last(F.when(name.isNotNull(), F.col("n")), True).over(w),
        "begin": F.last(F.when(line.startswith("@@"), F.regexp_extract("line", r"\+([0-9]+)", 1).cast("long")), True).over(w),
    })
    each = each.where((F.col("hunk") < F.col("n")) & (F.coalesce("head", F.lit(0)) < F.col("hunk")) & ~line.startswith("-") & ~line.startswith("\\"))
    nth = F.row_number().over(Window.partitionBy("__diff", "hunk").orderBy("n"))
    each = each.withColumn("line_no", F.col("begin") + nth - 1)
    return each.where(F.col("line").startswith("+")).select(*key, "file", F.col("line_no").cast("long").alias("line_no"), F.expr("substring(line, 2)").alias("content"))


IMPORT = r"""(?:from\s+|import\s+|require\(\s*|import\(\s*)['"](\.[^'"]*)['"]"""


def relative_imports(added: DataFrame) -> DataFrame:
    """file, line_no, source, target: relative imports in lines(file, line_no, content)."""
    found = F.explode(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1)))
    each = added.select("file", "line_no", found.alias("source"))
    return each.withColumn("target", normal_path(F.concat(F.regexp_replace("file", "[^/]*$", ""), F.col("source"))))


def layer_of(paths: DataFrame, column: str, components: DataFrame, name: str, whole_segments: bool = False) -> DataFrame:
    """paths with the layer of the first component whose path begins the path, or the other way
    round.  The components are a manifest's, so the join broadcasts them."""
    own = components.select("ord", F.col("path").alias("__p"), F.col("layer").alias(name))
    c = F.col(column)
    fits = (c.startswith(F.concat(F.col("__p"), F.lit("/"))) | (c == F.col("__p"))) if whole_segments else (c.startswith(F.col("__p")) | F.col("__p").startswith(c))
    best = paths.select(column).distinct().join(F.broadcast(own), fits).groupBy(column).agg(F.min_by(name, "ord").alias(name))
    return paths.join(best, column, "left")


def violations(imports: DataFrame, manifest: Manifest, whole_segments: bool = False) -> DataFrame:
    """file, line_no, source, from_layer, to_layer: imports between layers that the manifest doesn't allow."""
    allowed, components = manifest.tables(imports.sparkSession)
    own = layer_of(imports, "file", components, "from_layer", whole_segments)
    own = layer_of(own, "target", components, "to_layer", whole_segments).where("from_layer <> to_layer")
    return own.join(F.broadcast(allowed), ["from_layer", "to_layer"], "left_anti").select("file", "line_no", "source", "from_layer", "to_layer")


def check_files(corpus: DataFrame, manifest: Manifest) -> DataFrame:
    each = lines(corpus.select(F.col("path").alias("file"), "content"), "content", "content_line").withColumnRenamed("content_line", "content")
    return violations(relative_imports(each), manifest)


def check_diff(diffs: DataFrame, manifest: Manifest, text: str = "diff") -> DataFrame:
    return violations(relative_imports(parse_diff(diffs, text).select("file", "line_no", "content")), manifest)


# Rules over a manifest's components and their relationships -------------------------------------------


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def layer_boundary(relations: DataFrame) -> DataFrame:
    """Relations (source, target, type; paths) from a shallower to a deeper component that aren't depends_on."""
    return relations.where((depth(F.col("source")) < depth(F.col("target"))) & (F.col("type") != "depends_on"))


def unknown_components(relations: DataFrame, components: DataFrame) -> DataFrame:
    """Relations with an end that is no component, and which end."""
    ids = components.select(F.col("path").alias("__p")).distinct()
    out = [relations.join(ids, relations[e] == ids["__p"], "left_anti").withColumn("unknown", F.lit(e)) for e in ("source", "target")]
    return out[0].unionByName(out[1])


def composition(relations: DataFrame) -> DataFrame:
    """composes relations whose target doesn't lie below their source."""
    return relations.where((F.col("type") == "composes") & ~F.col("target").startswith(F.col("source")))


def _above(path: str) -> Column:
    """The folders that a path lies in, as it writes them."""
    parts = F.split(F.col(path), "/")
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) > 1, each).otherwise(F.array().cast("array<string>"))


def isolation(files: DataFrame, components: DataFrame) -> DataFrame:
    """Files under a component that has child components, but under none of them.  Files and components
    meet by the folders that they lie in, so neither needs to be small."""
    own = components.select(F.col("path").alias("parent")).distinct()
    child = components.select(F.col("path").alias("child")).distinct()
    below = child.select("child", F.explode(_above("child")).alias("parent")).join(own, "parent")
    within = files.select("path").distinct().select("path", F.explode(_above("path")).alias("folder"))
    inside = within.withColumnRenamed("folder", "parent").join(below.select("parent").distinct(), "parent")
    covered = within.withColumnRenamed("folder", "child").join(below, "child").select("path", "parent").distinct()
    left = inside.join(covered, ["path", "parent"], "left_anti")
    return files.join(left, "path").select(*files.columns, "parent")


def large_files(corpus: DataFrame, most: int = 400) -> DataFrame:
    n = F.size(F.split("content", r"\r?\n"))
    return corpus.select("repository", "path", n.cast("long").alias("n_lines")).where(F.col("n_lines") > most)
