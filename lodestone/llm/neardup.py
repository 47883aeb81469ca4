"""Operator 6: near-duplicate embeddings by an epsilon grid order join.

Unit vectors with a cosine of at least t lie within eps = sqrt(2 - 2t) of each other, in every
projection too.  Vectors are rotated to the principal axes of a bounded sample, which keeps distances,
and sorted by their cells of width eps on the leading axes (the epsilon grid order).

1. A vector's code is its AXES leading coordinates and the length of the rest, as half floats: a unit
   vector whose cosines are never below the vectors' own, but for a bounded rounding.  Only codes are
   sorted and cut into intervals of BLOCK vectors.
2. The sequence is joined recursively: intervals form a tree of FAN children a node, and from the root
   down those pairs of nodes are kept whose boxes come within eps.  Each level is one join by parent, so
   no interval is held against all others.  A pair of intervals goes on with pieces of it, by boxes over
   all axes, and pieces that may meet by the cosines of their codes.  What is left of a pair are the rows
   that may have a partner on the other side: rows, never pairs of rows.
3. Whole vectors are fetched for these rows alone and joined by cosines in double precision.  The join
   is exact: no pair is missed.  Pieces that lie within eps of each other as a whole are linked without
   a look at their pairs, so that a crowd in one spot takes little work.

Equal vectors are one class with a count.  A pair of intervals gives for each of its vectors the
number of links and one edge to the root of its local component, never the pairs themselves, so that
a third of all rows in one spot gives rows in proportion to it.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, vectors of different lengths never link; among repeated rows each counts as a vector; rows
with a null id are kept and take no part; an empty table gives no rows; other columns are not read;
intervals of long vectors hold fewer of them, so that a task's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import partitions, picked, table, tidied, written
from lodestone.llm.components import components, roots

THRESHOLD = 0.95
#: Axes of a code, leading ones that order the grid, and the sample that gives the axes.
AXES, GRID, SAMPLE, SAMPLE_BYTES = 24, 8, 2000, 64 << 20
#: Vectors and bytes of vectors in an interval, codes and vectors in a piece, children of a node.
BLOCK, BLOCK_BYTES, CODES, PIECE, FAN = 8192, 16 << 20, 512, 128, 16
#: Rounding to half floats moves a coordinate by this share at most, and a cosine by twice that.
HALF = 2.0**-11
MARGIN = 1.01 * 2 * HALF


def _data(x: np.ndarray) -> tuple[str, np.ndarray]:
    """Rows as single floats where that is exact."""
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    return ("s", small) if (small.astype(np.float64) == x).all() else ("d", x.astype("<f8"))


def _vectors(data: list[bytes], n: int) -> np.ndarray:
    out = np.empty((len(data), n))
    for i, d in enumerate(data):
        out[i] = np.frombuffer(d, dtype="<f4" if d[:1] == b"s" else "<f8", offset=1)
    return out


def _classed(batches: Iterator[pa.RecordBatch]):
    """Length, data and digest of each vector that takes part, null for the others."""
    import hashlib

    for batch in batches:
        v = batch.column("v")
        lengths = np.where(v.is_valid().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy()), 0)
        data, digest = [None] * len(v), [None] * len(v)
        for n in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == n)
            x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) + 0.0
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            for i, row in zip(at[good], x[good]):
                kind, bare = _data(row)
                data[i] = kind.encode() + bare.tobytes()
                digest[i] = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(lengths, pa.int32()), pa.array(data, pa.binary()), pa.array(digest, pa.binary())], names=["key", "n", "data", "class"])


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def principal(x: np.ndarray, count: int) -> np.ndarray:
    """The leading principal axes of rows, as columns, by subspace iteration."""
    x = x - x.mean(0)
    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(x.shape[1], min(x.shape[1], count + 8))))[0]
    for _ in range(8):
        turn = np.linalg.qr(x.T @ (x @ turn))[0]
    return (turn @ np.linalg.svd(x @ turn, full_matrices=False)[2].T)[:, :count] if len(x) >= turn.shape[1] else turn[:, :count]


def axes(classes: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each length of vector the principal axes of the sample, as columns."""
    by: dict[int, list] = {}
    sample = min(sample, max(1, SAMPLE_BYTES // (8 * (classes.agg(F.max("n")).first()[0] or 1))))
    for r in classes.orderBy(F.xxhash64("class")).limit(sample).select("n", "data").collect():
        by.setdefault(r.n, []).append(bytes(r.data))
    out = {}
    for n, vs in by.items():
        out[n] = principal(unit(_vectors(vs, n)), AXES)
    return out


def codes(x: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
    """Leading coordinates and the length of the rest, of unit rows."""
    n = x.shape[1]
    y = x @ known.get(n, np.eye(n)[:, :AXES])
    rest = np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1))) if n > y.shape[1] else np.zeros(len(y))
    return np.hstack([y, np.zeros((len(y), AXES - y.shape[1])), rest[:, None]])


def _placed(batches: Iterator[pa.RecordBatch], known: dict[int, np.ndarray], eps: float):
    """The code of each vector, and its place in the epsilon grid order as one number: length, then cells."""
    width = int(np.ceil(1 / eps)) + 1
    for batch in batches:
        lengths = batch.column("n").to_numpy()
        place, half = np.zeros(batch.num_rows), np.zeros((batch.num_rows, AXES + 1), dtype="<f2")
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            c = codes(unit(_vectors(batch.column("data").take(pa.array(own)).to_pylist(), int(n))), known)
            cell = np.clip(np.floor(c[:, :GRID] / eps).astype(np.int64) + width, 0, 2 * width - 1)
            p = np.full(len(c), float(n))
            for i in range(cell.shape[1]):
                p = p * (2 * width) + cell[:, i]
            place[own], half[own] = p, c
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array([h.tobytes() for h in half], pa.binary()), pa.array(place)], names=["node", "n", "code", "place"])


_SIDES = [f"{s}{i}" for s in ("lo", "hi") for i in range(GRID)]
_BLOCKS = pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("n", pa.int32()), *[(c, pa.float64()) for c in _SIDES], ("nodes", pa.binary()), ("codes", pa.binary())])
_BLOCKS_DDL = f"part int, nth long, n int, {', '.join(f'{c} double' for c in _SIDES)}, nodes binary, codes binary"


def _cut(batches: Iterator[pa.RecordBatch]):
    """Intervals of the sequence, each of vectors of one length."""
    from pyspark import TaskContext

    part, nth = TaskContext.get().partitionId(), 0
    held: list[tuple[int, np.ndarray, bytes]] = []

    def out(last: bool):
        nonlocal nth
        n = held[0][0]
        nodes, code = np.concatenate([h[1] for h in held]), np.frombuffer(b"".join(h[2] for h in held), dtype="<f2").reshape(-1, AXES + 1)
        held.clear()
        size = max(1, min(BLOCK, BLOCK_BYTES // (8 * n)))
        end = len(nodes) if last else len(nodes) // size * size
        for a in range(0, end, size):
            c = code[a : min(end, a + size)].astype(np.float64)[:, :GRID]
            wide = HALF * np.abs(c).max(0) + 1e-7
            box = dict(zip(_SIDES, [*(c.min(0) - wide).tolist(), *(c.max(0) + wide).tolist()]))
            yield pa.RecordBatch.from_pylist([{"part": part, "nth": nth, "n": n, **box, "nodes": nodes[a : min(end, a + size)].tobytes(), "codes": code[a : min(end, a + size)].tobytes()}], schema=_BLOCKS)
            nth += 1
        if end < len(nodes):
            held.append((n, nodes[end:], code[end:].tobytes()))

    for batch in batches:
        lengths = batch.column("n").to_numpy()
        bounds = np.flatnonzero(np.concatenate([[True], lengths[1:] != lengths[:-1], [True]])) if len(lengths) else [0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if held and held[0][0] != lengths[a]:
                yield from out(True)
            held.append((int(lengths[a]), batch.column("node").to_numpy()[a:b], b"".join(batch.column("code").slice(a, b - a).to_pylist())))
            if sum(len(h[1]) for h in held) >= BLOCK:
                yield from out(False)
    if held:
        yield from out(True)


def interval_pairs(blocks: DataFrame, count: int, eps: float) -> DataFrame:
    """a, b with a <= b: the intervals (seq, n and boxes) that may hold vectors within eps, found from
    the root of the tree over the sequence down, one join by parents for each level."""
    depth = 1
    while FAN**depth < count:
        depth += 1
    pairs = None
    for level in reversed(range(depth)):
        node = F.floor(F.col("seq") / FAN**level).cast("long")
        boxes = [F.min(c).alias(c) if c.startswith("lo") else F.max(c).alias(c) for c in _SIDES]
        nodes = blocks.groupBy(node.alias("node")).agg(F.min("n").alias("lon"), F.max("n").alias("hin"), *boxes)

        def side(x: str, nodes: DataFrame = nodes) -> DataFrame:
            return nodes.select(F.floor(F.col("node") / FAN).cast("long").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in nodes.columns])

        apart: Column = F.lit(0.0)
        for i in range(GRID):
            gap = F.greatest(F.col(f"lo{i}_a") - F.col(f"hi{i}_b"), F.col(f"lo{i}_b") - F.col(f"hi{i}_a"), F.lit(0.0))
            apart = apart + gap * gap
        # The root is its own partner, so its children meet by their parent.
        met = side("a").join(side("b"), F.col("a") == F.col("b")) if pairs is None else pairs.join(side("a"), "a").join(side("b"), "b")
        met = met.where((F.col("node_a") <= F.col("node_b")) & (F.col("lon_a") <= F.col("hin_b")) & (F.col("lon_b") <= F.col("hin_a")) & (apart <= eps * eps * (1 + 1e-9) + 1e-12))
        pairs = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        if level:
            pairs = written(pairs)
    return pairs


def near_pieces(p: np.ndarray, q: np.ndarray, size: int, limit: float, same: bool) -> Iterator[tuple[int, int]]:
    """First rows of the pieces of p and q whose boxes come within the square root of limit."""
    low = lambda x: np.array([x[i : i + size].min(0) for i in range(0, len(x), size)])
    high = lambda x: np.array([x[i : i + size].max(0) for i in range(0, len(x), size)])
    gap = np.maximum(0, np.maximum(low(p)[:, None] - high(q)[None], low(q)[None] - high(p)[:, None]))
    near = (gap * gap).sum(axis=2) <= limit
    for i, j in np.argwhere(np.triu(near) if same else near):
        yield int(i) * size, int(j) * size


def possible(x: np.ndarray, y: np.ndarray, t: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of x and of y may have a partner on the other side, by their codes."""
    rows, cols = np.zeros(len(x), dtype=bool), np.zeros(len(y), dtype=bool)
    for i, j in near_pieces(x, y, CODES, 2 - 2 * t + 4 * MARGIN, same):
        cosines = x[i : i + CODES] @ y[j : j + CODES].T
        if same and i == j:
            np.fill_diagonal(cosines, -1)
        if cosines.size and cosines.max() >= t - MARGIN:
            hit = cosines >= t - MARGIN
            rows[i : i + CODES] |= hit.any(axis=1)
            cols[j : j + CODES] |= hit.any(axis=0)
    return rows, cols


_ASKED = ["a", "b", "right", "node"]


def _screened(batches: Iterator[pa.RecordBatch], t: float):
    """The rows of each pair of intervals that may have a partner on the other side."""
    for batch in batches:
        for r in batch.to_pylist():
            same = r["a"] == r["b"]
            sides = [(np.frombuffer(r[f"nodes_{s}"], dtype="<i8"), np.frombuffer(r[f"codes_{s}"], dtype="<f2").astype(np.float32).reshape(-1, AXES + 1)) for s in ("a" if same else "ab")]
            rows, cols = possible(sides[0][1], sides[-1][1], t, same)
            found = [sides[0][0][rows | cols]] if same else [sides[0][0][rows], sides[1][0][cols]]
            for right, nodes in enumerate(found):
                if len(nodes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), r["a"])), pa.array(np.full(len(nodes), r["b"])), pa.array([bool(right)] * len(nodes)), pa.array(nodes)], names=_ASKED)


def cosine_at_least(x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Which cosines of unit rows reach t; those that rounding leaves open are summed exactly."""
    import math

    cosines = x @ y.T
    out = cosines >= t
    if np.abs(cosines - t).min(initial=1) < 1e-13:
        for i, j in np.argwhere(np.abs(cosines - t) < 1e-13):
            out[i, j] = math.fsum(x[i] * y[j]) / math.sqrt(math.fsum(x[i] * x[i]) * math.fsum(y[j] * y[j])) >= t
    return out


def links_between(x: np.ndarray, y: np.ndarray, known: dict[int, np.ndarray], t: float, same: bool) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """('pairs', rows of x, rows of y) that are linked, or ('all', ...) where every row of the one is
    linked with every other row of the other."""
    eps = float(np.sqrt(2 - 2 * t))
    spans = {}
    for s, z in (("x", x), ("y", y)):
        spans[s] = {}
        for i in range(0, len(z), PIECE):
            centre = z[i : i + PIECE].mean(0)
            spans[s][i] = centre, float(np.sqrt(((z[i : i + PIECE] - centre) ** 2).sum(1).max()))
    for i, j in near_pieces(codes(x, known), codes(y, known), PIECE, eps * eps * (1 + 1e-9) + 1e-9, same):
        one, two = x[i : i + PIECE], y[j : j + PIECE]
        (c, r), (d, s) = spans["x"][i], spans["y"][j]
        if float(np.sqrt(((c - d) ** 2).sum())) + r + s <= eps * (1 - 1e-9) - 1e-9:
            yield "all", np.arange(i, i + len(one)), np.arange(j, j + len(two))
            continue
        hit = cosine_at_least(one, two, t)
        a, b = np.nonzero(np.triu(hit, 1) if same and i == j else hit)
        if len(a):
            yield "pairs", a + i, b + j


def _joined(batches: Iterator[pa.RecordBatch], known: dict[int, np.ndarray], t: float):
    """node, links, root for each vector with links within a pair of intervals, whose rows come one
    after another."""

    def out(pair: tuple[int, int], held: list[tuple]):
        n, same = held[0][3], pair[0] == pair[1]
        held.sort(key=lambda h: h[0])
        node, count = (np.array([h[i] for h in held], dtype=np.int64) for i in (1, 2))
        x = unit(_vectors([h[4] for h in held], n))
        cut = len(held) if same else sum(not h[0] for h in held)
        order = np.arange(len(held))
        for a, b in ((0, cut), (cut, len(held))):  # each side in the grid order
            cells = np.floor(codes(x[a:b], known)[:, :GRID] / np.sqrt(2 - 2 * t))
            order[a:b] = a + np.lexsort(cells.T[::-1])
        node, count, x = node[order], count[order], x[order]
        links, found = np.zeros(len(node), dtype=np.int64), []
        for kind, a, b in links_between(x[:cut], x[:cut] if same else x[cut:], known, t, same):
            b = b if same else b + cut
            if kind == "pairs":
                np.add.at(links, a, count[b])
                np.add.at(links, b, count[a])
                found.append((a, b))
            elif a[0] == b[0]:
                links[a] += count[a].sum() - count[a]
                found.append((np.full(len(a), a[0]), a))
            else:
                links[a] += count[b].sum()
                links[b] += count[a].sum()
                found += [(np.full(len(b), a[0]), b), (a, np.full(len(a), b[0]))]
        root = roots(len(node), found)
        hit = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(node[root[hit]])], names=["node", "links", "root"])

    pair, held = None, []
    for batch in batches:
        for a, b, *row in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "right", "node", "count", "n", "data"))):
            if (a, b) != pair and held:
                yield out(pair, held)
                held = []
            pair = a, b
            held.append(tuple(row))
    if held:
        yield out(pair, held)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """key, n_links, component_id, kept: one row for each vector."""
    spark, eps = vectors.sparkSession, float(np.sqrt(2 - 2 * threshold))
    own = picked(vectors, key=vectors[key].cast("long"), v=vectors[vector].cast("array<double>"))
    rows = written(own.mapInArrow(tidied(_classed), "key long, n int, data binary, class binary"))
    good = rows.where("class IS NOT NULL AND key IS NOT NULL")
    classes = good.groupBy("class").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("count"), F.first("n").alias("n"), F.first("data").alias("data"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    known = axes(classes)
    placed = classes.select("node", "n", "data").mapInArrow(tidied(lambda b: _placed(b, known, eps)), "node long, n int, code binary, place double")
    order = written(placed).repartitionByRange(partitions(spark), "place", "node").sortWithinPartitions("place", "node")
    blocks = written(order.select("node", "n", "code").mapInArrow(tidied(_cut), _BLOCKS_DDL))
    # One row for each partition of the sequence: the number of intervals before it.
    before, total = [], 0
    for r in blocks.groupBy("part").agg(F.count(F.lit(1)).alias("count")).orderBy("part").collect():
        before.append((r.part, total))
        total += r["count"]
    numbered = blocks.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part").withColumn("seq", F.col("before") + F.col("nth"))
    pairs = written(interval_pairs(numbered.select("seq", "n", *_SIDES), total, eps))

    side = lambda x: numbered.select(F.col("seq").alias(x), F.col("nodes").alias(f"nodes_{x}"), F.col("codes").alias(f"codes_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", "nodes_a", "codes_a", *[F.when(F.col("a") != F.col("b"), F.col(c)).alias(c) for c in ("nodes_b", "codes_b")])
    asked = written(both.mapInArrow(tidied(lambda b: _screened(b, threshold)), "a long, b long, right boolean, node long"))
    whole = asked.join(classes.select("node", "count", "n", "data"), "node")
    whole = whole.repartition("a", "b").sortWithinPartitions("a", "b")
    found = written(whole.mapInArrow(tidied(lambda b: _joined(b, known, threshold)), "node long, links long, root long"))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    near = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    each = classes.select("class", "node", "least", "count").join(links, "node", "left").join(near, "node", "left")
    each = written(each.withColumns({"component": F.coalesce("component", "node"), "links": F.coalesce("links", F.lit(0)) + F.col("count") - 1}))
    least = each.groupBy("component").agg(F.min("least").alias("component_id"))
    named = each.join(least, "component").select("class", "links", "component_id")
    linked = good.select("key", "class").join(named, "class").select("key", "links", "component_id")
    alone = rows.where("class IS NULL OR key IS NULL").select("key", F.lit(0).cast("long").alias("links"), F.col("key").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("key").alias(key), F.col("links").alias("n_links"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_near_duplicates": op6_near_duplicates}
ORACLES: dict = {}
