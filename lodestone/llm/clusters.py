"""Operator 13: clustering of vectors around centroids by partial-distance search, in whole numbers.

Components become floor(64 * x), so that distances, sums and centroids are exact and the same wherever the
rows are.  A few rounds assign every vector to its nearest centroid and move each centroid to the floor of
its vectors' mean; then vectors are assigned once more.

The search adds up squared differences over the dimensions of the largest variance first (over all vectors;
the order changes no result).  A vector's best guess after the first dimensions is finished at once and is
the distance to beat: a centroid whose sum is strictly above it is abandoned at the next bound, and those
that survive all dimensions compete, ties going to the smaller number.

Only counts and sums leave a task: a row for each centroid, CENTROIDS at most.  What reaches the driver is
a row for each centroid and dimension; centroids travel to tasks with the kernel.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no
part, nor do rows without an id; repeated rows count each, and of seeds with equal hashes the smaller vector
comes first; with fewer vectors than centroids there are as many centroids as vectors; a centroid without
vectors stays where it is; equal centroids leave all vectors to the smaller number; an empty table gives no
rows; other columns are not read.  Components of any size are handled (above 2**27 by Python's whole
numbers); a distance or sum past the range of a long raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import picked, table, tidied, written

CENTROIDS, DIMENSIONS, SCALE, ROUNDS, SEED = 16, 64, 64, 3, "1"
#: After so many dimensions centroids are abandoned; vectors searched at a time; components that int64 holds.
BOUNDS, STEP, SMALL = (8, 16, 32), 2048, 1 << 27
_LONG = 1 << 63


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """key, v: the components as whole numbers (as doubles, which are exact here), of vectors that take part."""
    own = picked(vectors, key=vectors[key].cast("long"), v=vectors[vector].cast("array<double>"))
    fit = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    own = own.where(F.col("key").isNotNull() & (F.size("v") == dimensions) & fit)
    # A double above 2**53 is whole already, and floor() would cut it to a long.
    return own.select("key", F.transform("v", lambda x: F.when(F.abs(x * scale) < float(1 << 53), F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("v"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    if np.abs(flat).max(initial=0) < SMALL:
        return flat.astype(np.int64)
    if not np.isfinite(flat).all():
        raise ValueError("a component passes the range of a double")
    return np.array([[int(x) for x in row] for row in flat], dtype=object)


def _long(x: int) -> int:
    if not -_LONG <= x < _LONG:
        raise ValueError("a distance or sum passes the range of a long")
    return int(x)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, bounds: tuple[int, ...] = BOUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the squared distance, and how many sums were finished."""
    kind = np.int64 if x.dtype == np.int64 and np.abs(centroids).max(initial=0) < SMALL else object
    x, c = x[:, order].astype(kind), centroids[:, order].astype(kind)
    edges = sorted({min(b, x.shape[1]) for b in (*bounds, x.shape[1])})
    part = ((x[:, None, : edges[0]] - c[None, :, : edges[0]]) ** 2).sum(2)
    rows = np.arange(len(x))
    guess = part.argmin(1)
    best = part[rows, guess] + ((x[:, edges[0] :] - c[guess, edges[0] :]) ** 2).sum(1)
    i, j = np.nonzero((part <= best[:, None]) & (np.arange(len(c)) != guess[:, None]))
    p = part[i, j]
    for a, b in zip(edges, edges[1:]):
        p = p + ((x[i, a:b] - c[j, a:b]) ** 2).sum(1)
        left = (p <= best[i]).astype(bool)
        i, j, p = i[left], j[left], p[left]
    for row, number, d in zip(i, j, p):  # few: the survivors
        if d < best[row] or (d == best[row] and number < guess[row]):
            best[row], guess[row] = d, number
    return guess, best


def seeds(rows: DataFrame, count: int, seed: str = SEED) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id."""
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256).alias("hash"), "v")
    return [[int(x) for x in r.v] for r in hashed.orderBy("hash", "v").limit(count).collect()]


def by_variance(rows: DataFrame, dimensions: int) -> np.ndarray:
    """The dimensions, those of the largest variance over all vectors first."""
    sums = [F.try_sum(F.col("v")[i]).alias(f"s{i}") for i in range(dimensions)] + [F.try_sum(F.col("v")[i] * F.col("v")[i]).alias(f"q{i}") for i in range(dimensions)]
    r = rows.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    n = r.n or 1
    with np.errstate(all="ignore"):
        s, q = (np.array([r[f"{x}{i}"] or 0 for i in range(dimensions)], dtype=float) / n for x in "sq")
        spread = q - s * s
    return np.argsort(-np.nan_to_num(spread), kind="stable")


def _searched(batch: pa.RecordBatch, centroids: np.ndarray, order: np.ndarray):
    """Parts of a batch: the matrix, each row's centroid and distance."""
    for a in range(0, len(batch), STEP):
        x = _matrix(batch.column("v").slice(a, STEP), centroids.shape[1])
        yield a, x, *nearest(x, centroids, order)


def moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after every vector went to its nearest."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]):
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, d), dtype=object)
        for batch in batches:
            for _, x, own, _ in _searched(batch, centroids, order):
                for c in np.unique(own):
                    n[c] += (own == c).sum()
                    sums[c] += x[own == c].sum(0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pylist([{"cluster": int(c), "n": int(n[c]), "sums": [_long(s) for s in sums[c]]} for c in used], schema=pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    found = rows.mapInArrow(tidied(run), "cluster int, n long, sums array<long>")
    each = found.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    out = centroids.astype(object)
    for r in each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k x d rows at most
        out[r.cluster, r.i] = int(r.s) // r.n
    return out if max((abs(x) for x in out.flat), default=0) >= SMALL else out.astype(np.int64)


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid (its components) of every vector."""
    rows = written(whole_vectors(vectors, key, vector, dimensions, scale))
    spark = rows.sparkSession
    first = seeds(rows, centroids, seed)
    if not first:
        return spark.createDataFrame([], f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    at = np.array(first, dtype=object)
    at = at if max(abs(x) for x in at.flat) >= SMALL else at.astype(np.int64)
    order = by_variance(rows, dimensions)
    for _ in range(rounds):
        at = moved(rows, at, order)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a, x, own, away in _searched(batch, at, order):
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, len(x)), pa.array(own, type=pa.int32()), pa.array([_long(d) for d in away], type=pa.int64())], names=["key", "cluster", "distance"])

    found = written(rows.mapInArrow(tidied(run), "key long, cluster int, distance long"))
    sums = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row for each centroid
    total = _long(sum(map(int, sums.values())))
    known = spark.createDataFrame([(c, _long(int(d)), total, [_long(x) for x in at[c]]) for c, d in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(known), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustered(table(spark, sf_dir, "embeddings"))
    return out.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ","), 256)).drop("centroid")


def _oracle() -> str:
    away = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))::BIGINT"
    parts = [
        rf"""v AS MATERIALIZED (
      SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1)::INT AS c, v FROM v ORDER BY sha256('{SEED}:' || vec_id), v LIMIT {CENTROIDS})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT r, vec_id, any_value(v.v) AS v, min({{'d': {away}, 'c': c.c}}) AS own FROM v, c{r} AS c GROUP BY r, vec_id)")
        if r < ROUNDS:
            mean = "list((s - ((s % n) + n) % n) // n ORDER BY i)"
            each = f"SELECT own.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {DIMENSIONS + 1}) AS t(i) GROUP BY 1, 2"
            parts.append(f"m{r} AS (SELECT c, {mean} AS v FROM ({each}) GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN m{r} AS m ON c.c = m.c)")
    return f"""
    WITH {", ".join(parts)}
    SELECT vec_id, own.c AS cluster, own.d AS distance, (sum(own.d) OVER (PARTITION BY own.c))::BIGINT AS cluster_inertia, (sum(own.d) OVER ())::BIGINT AS inertia,
      sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{ROUNDS} AS a JOIN c{ROUNDS} AS c ON a.own.c = c.c
    """


QUERIES = {"op13_centroid_clusters": op13_centroid_clusters}
ORACLES = {"op13_centroid_clusters": _oracle()}
