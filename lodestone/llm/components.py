"""Connected components by alternating large and small stars, all on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written


def roots(n: int, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest number that each of n nodes reaches by pairs of nodes, within one task."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for a, b in found:
            least = np.minimum(root[a], root[b])
            for x in (root[a], root[b], a, b):
                np.minimum.at(root, x, least)
        root = root[root]
        if (root == before).all():
            return root


def components(edges: DataFrame) -> DataFrame:
    """id, component: for each id that an edge (a, b: long) between different ids names, the
    smallest id that it reaches.  Rounds grow with the logarithm of the number of ids."""
    own = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    own = written(own.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        n, check = own.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if (n, check) == before:
            return own.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(own.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = (n, check)
        # Large star: each neighbour that is larger goes to the smallest one.
        both = own.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(own.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the smaller neighbours and the id itself go to the smallest one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
