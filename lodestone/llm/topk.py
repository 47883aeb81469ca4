"""Operator 9: exact top-k search as a Voronoi join.

Components are turned into integers, so that scores (inner products) are exact.  Pivots, drawn from a
bounded sample, split queries and data into cells; a cell is dealt into blocks of a bounded size, so no
cell, however many rows fall into it, is one task's.  Each vector goes to its block once.

1. A query is itself a row of a block, where it first meets that block alone.  The k-th best score it
   finds there is a score that its k-th best answer must reach.
2. Summaries of the cells - the pivot, the largest distance to it, the largest length - bound what a
   query q can score there: a vector d of the cell of pivot p scores at most p.q + |q| * radius, and at
   most |q| * the largest length.  A query is copied to the blocks of those cells alone that can reach
   its score.  Queries are the smaller side, so they are copied, and the data are not.
3. Each block is solved for the queries copied to it; only answers that reach the query's score leave
   it, and are merged by query.

Broadcast are the pivots and the cells' summaries: PIVOTS at most for each length of vector, whatever
the data's size.  Where the data are close to isotropic, as the test tables' are, triangle inequalities
can't tell cells apart, and every query meets most blocks; see the README for the shares measured.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; only
vectors of the same length are compared; queries with fewer candidates have fewer rows, and those
without any none; ties go to the smaller id, among repeated rows of an id each row counts, and each is a
query with rows of its own; a row of a query's own id is never a candidate of it; null ids take no part;
an empty table gives no rows; other columns are not read.  Blocks of long vectors hold fewer of them.
Scores are exact up to 2**63, beyond which the search raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import picked, table, tidied, written

K, SCALE, EVERY = 5, 256, 50
#: Cells at most, vectors for each cell, the sample that pivots come from, and bytes of vectors in a block.
PIVOTS, PER_CELL, SAMPLE, SAMPLE_BYTES, BLOCK_BYTES = 1024, 4096, 4096, 64 << 20, 8 << 20
#: Queries of a block that are scored at a time.
STEP = 128


def integers(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """key and the components as floor(scale * x), x as double; without vectors that take no part."""
    own = picked(vectors, key=vectors[key].cast("long"), v=vectors[vector].cast("array<double>"))
    fit = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    own = own.where(F.col("key").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fit)
    return own.select("key", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch):
    """(length, rows, keys, matrix) for each length of vector in a batch."""
    lengths = np.diff(batch.column("v").offsets.to_numpy())
    for n in np.unique(lengths):
        rows = batch.filter(pa.array(lengths == n)) if (lengths != n).any() else batch
        yield int(n), rows, rows.column("key").to_numpy(), _matrix(rows.column("v"))


def pivots(rows: DataFrame, count: int, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each length of vector the pivots: a few rounds of k-means over the sample's rows."""
    first = rows.orderBy(F.xxhash64("key"), "number").limit(sample).select("v").collect()
    by: dict[int, list] = {}
    for r in first:
        by.setdefault(len(r.v), []).append(r.v)
    out = {}
    for n, vs in by.items():
        x = np.array(vs)
        p = np.unique(x, axis=0)
        p = p[np.linspace(0, len(p) - 1, min(count, len(p))).astype(int)]
        for _ in range(5):
            own = ((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)).argmin(1)
            p = np.array([x[own == i].mean(0) if (own == i).any() else p[i] for i in range(len(p))])
        out[n] = p
    return out


def _cells(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The nearest pivot of each row."""
    return ((p * p).sum(1) - 2 * x @ p.T).argmin(1)


def _pivot_of(n: int, known: dict[int, np.ndarray]) -> np.ndarray:
    return known.get(n, np.zeros((1, n)))  # lengths outside the sample have one cell


def _bytes(x: np.ndarray) -> bytes:
    """As 2-byte integers where that is exact."""
    small = x.astype("<i2") if np.abs(x).max(initial=0) < 32768 else None
    return b"d" + x.astype("<f8").tobytes() if small is None else b"s" + small.tobytes()


def _vectors(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data[1:], dtype="<i2" if data[:1] == b"s" else "<f8").reshape(-1, n).astype(np.float64)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors; beyond the range where doubles are exact, by integers."""
    largest = np.sqrt((q * q).sum(1).max(initial=0)) * np.sqrt((x * x).sum(1).max(initial=0))
    if largest < 2**52:
        return q @ x.T
    whole = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], dtype=object)
    out = whole(q) @ whole(x).T
    if any(not -(2**63) <= s < 2**63 for r in out.tolist() for s in r):
        raise ValueError("a score passes the range of a long")
    return out.astype(np.int64)


def best(queries: np.ndarray, q: np.ndarray, keys: np.ndarray, x: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place of the query, key and score of the best k of each query within a block, among those of
    other ids and, if given, of at least the query's least score."""
    out = []
    for a in range(0, len(queries), STEP):
        scores = _scores(q[a : a + STEP], x)
        other = queries[a : a + STEP, None] != keys[None, :]
        if least is not None:
            other &= scores >= least[a : a + STEP, None]
        if len(keys) > k:
            # Ties at the edge go to the smaller id, so all of them are looked at.
            low = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
            edge = np.partition(np.where(other, scores, low), len(keys) - k, axis=1)[:, len(keys) - k]
            other &= scores >= edge[:, None]
        row, col = np.nonzero(other)
        order = np.lexsort((keys[col], -scores[row, col], row))
        row, col = row[order], col[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((row[keep] + a, keys[col[keep]], scores[row[keep], col[keep]].astype(np.int64)))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, dtype=np.int64) for i in range(3))


_DEALT_DDL = "n int, cell int, block long, keys binary, numbers binary, vectors binary"
_DEALT = pa.schema([("n", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary()), ("vectors", pa.binary())])
#: Rows of kind 0 are blocks, of kind 1 queries with what they found in their own block.
_FIRST_DDL = "kind int, n int, cell int, block long, keys binary, vectors binary, radius double, norm double, query_id long, number long, least long, own array<struct<key: long, score: long>>"
_FIRST = pa.schema([("kind", pa.int32()), ("n", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("vectors", pa.binary()), ("radius", pa.float64()), ("norm", pa.float64()), ("query_id", pa.int64()), ("number", pa.int64()), ("least", pa.int64()), ("own", pa.list_(pa.struct([("key", pa.int64()), ("score", pa.int64())])))])
_COPY_DDL = "n int, cell int, block long, keys binary, numbers binary, vectors binary, leasts binary, query boolean"
_COPY = pa.schema([("n", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary()), ("vectors", pa.binary()), ("leasts", pa.binary()), ("query", pa.bool_())])
_LOW = -(2**63)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def first_pass(rows: DataFrame, known: dict[int, np.ndarray], blocks: dict[tuple[int, int], int], every: int, k: int) -> DataFrame:
    """Blocks of vectors, and every query with its best answers within its own block."""

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for n, own, keys, x in _by_length(batch):
                numbers = own.column("number").to_numpy()
                cell = _cells(x, _pivot_of(n, known))
                block = _mixed(numbers) % np.array([blocks.get((n, c), 1) for c in range(len(_pivot_of(n, known)))])[cell]
                order = np.lexsort((block, cell))
                new = np.flatnonzero(np.concatenate([[True], (np.diff(cell[order]) != 0) | (np.diff(block[order]) != 0), [True]]))
                for a, b in zip(new[:-1], new[1:]):
                    at = order[a:b]
                    out.append({"n": n, "cell": int(cell[at[0]]), "block": int(block[at[0]]), "keys": keys[at].astype("<i8").tobytes(), "numbers": numbers[at].astype("<i8").tobytes(), "vectors": _bytes(x[at])})
            yield pa.RecordBatch.from_pylist(out, schema=_DEALT)

    def assembled(group: tuple[int, int, int], held: list[tuple]):
        n, cell, block = group
        keys, numbers = (np.frombuffer(b"".join(h[i] for h in held), dtype="<i8") for i in (0, 1))
        x = np.concatenate([_vectors(h[2], n) for h in held])
        away, norm = np.sqrt(((x - _pivot_of(n, known)[cell]) ** 2).sum(1).max()), np.sqrt((x * x).sum(1).max())
        base = {"n": n, "cell": cell, "block": block}
        out = [{"kind": 0, **base, "keys": keys.tobytes(), "vectors": _bytes(x), "radius": float(away), "norm": float(norm)}]
        asks = np.flatnonzero(keys % every == 0)
        row, key, score = best(keys[asks], x[asks], keys, x, k)
        bounds = np.searchsorted(row, np.arange(len(asks) + 1))
        for i, at in enumerate(asks):
            a, b = bounds[i], bounds[i + 1]
            own = [{"key": int(c), "score": int(s)} for c, s in zip(key[a:b], score[a:b])]
            out.append({"kind": 1, **base, "vectors": _bytes(x[at : at + 1]), "query_id": int(keys[at]), "number": int(numbers[at]), "least": own[-1]["score"] if len(own) == k else _LOW, "own": own})
        return pa.RecordBatch.from_pylist(out, schema=_FIRST)

    def assemble(batches: Iterator[pa.RecordBatch]):
        group, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["n"], r["cell"], r["block"]) != group:
                    if held:
                        yield assembled(group, held)
                    group, held = (r["n"], r["cell"], r["block"]), []
                held.append((r["keys"], r["numbers"], r["vectors"]))
        if held:
            yield assembled(group, held)

    dealt = rows.mapInArrow(tidied(deal), _DEALT_DDL).repartition("n", "cell", "block").sortWithinPartitions("n", "cell", "block")
    return written(dealt.mapInArrow(tidied(assemble), _FIRST_DDL))


def reachable(q: np.ndarray, least: np.ndarray, p: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """queries x cells: whether the cell may hold a vector of at least the query's least score."""
    own = np.sqrt((q * q).sum(1))[:, None]
    most = np.minimum(q @ p.T + own * radius, own * norm)
    # Rounding of the bound must never cost an answer.
    return (most + 1e-6 * (1 + np.abs(most)) >= least.astype(float)[:, None]) & (norm >= 0)


def copies(first: DataFrame, known: dict[int, np.ndarray], summary: dict) -> DataFrame:
    """Queries, packed for each block that may hold answers of theirs, but for their own block."""
    of = {}
    for n in {m for m, _ in summary}:
        cells = range(len(_pivot_of(n, known)))
        of[n] = [np.array([getattr(summary[n, c], f) if (n, c) in summary else -1.0 for c in cells]) for f in ("radius", "norm")]

    def copy(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            by: dict[int, list] = {}
            for r in batch.to_pylist():
                by.setdefault(r["n"], []).append(r)
            for n, rows in by.items():
                q = np.concatenate([_vectors(r["vectors"], n) for r in rows])
                key, number, least, cell, block = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("query_id", "number", "least", "cell", "block"))
                may = reachable(q, least, _pivot_of(n, known), *of[n])
                out = []
                for c in np.flatnonzero(may.any(0)):
                    for b in range(int(summary[n, c].blocks)):
                        at = np.flatnonzero(may[:, c] & ~((cell == c) & (block == b)))
                        if len(at):
                            out.append({"n": n, "cell": int(c), "block": b, "keys": key[at].astype("<i8").tobytes(), "numbers": number[at].astype("<i8").tobytes(), "vectors": _bytes(q[at]), "leasts": least[at].astype("<i8").tobytes(), "query": True})
                    if len(out) > 64:
                        yield pa.RecordBatch.from_pylist(out, schema=_COPY)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=_COPY)

    return first.where("kind = 1").select("n", "cell", "block", "query_id", "vectors", "number", "least").mapInArrow(tidied(copy), _COPY_DDL)


def cell_summaries(first: DataFrame) -> dict:
    """(length, cell) -> blocks, largest distance to the pivot, largest length of a vector."""
    own = first.where("kind = 0").groupBy("n", "cell").agg(F.count(F.lit(1)).alias("count"), F.max("block").alias("last"), F.max("radius").alias("radius"), F.max("norm").alias("norm"))
    return {(r.n, r.cell): r for r in own.select("n", "cell", (F.col("last") + 1).alias("blocks"), "radius", "norm").collect()}


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE, block_bytes: int = BLOCK_BYTES, per_cell: int = PER_CELL) -> DataFrame:
    """query_id, rank, key, score: the k best candidates of every query, which are the rows whose id
    ``every`` divides; k rows for each of repeated rows of an id."""
    rows = written(integers(vectors, key, vector, scale).withColumn("number", F.monotonically_increasing_id()))
    total, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    sample = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * (longest or 1))))
    known = pivots(rows, max(1, min(PIVOTS, total // per_cell)), sample)
    room = lambda n: max(1, block_bytes // (8 * n))

    def counted(batches: Iterator[pa.RecordBatch]):
        held: dict[tuple[int, int], int] = {}
        for batch in batches:
            for n, _, _, x in _by_length(batch):
                for c, m in zip(*np.unique(_cells(x, _pivot_of(n, known)), return_counts=True)):
                    held[n, int(c)] = held.get((n, int(c)), 0) + int(m)
        yield pa.RecordBatch.from_pylist([{"n": n, "cell": c, "rows": m} for (n, c), m in held.items()], schema=pa.schema([("n", pa.int32()), ("cell", pa.int32()), ("rows", pa.int64())]))

    counts = rows.mapInArrow(tidied(counted), "n int, cell int, rows long").groupBy("n", "cell").agg(F.sum("rows").alias("rows")).collect()
    blocks = {(r.n, r.cell): -(-r.rows // room(r.n)) for r in counts}
    first = first_pass(rows, known, blocks, every, k)
    sent = copies(first, known, cell_summaries(first))
    none = F.lit(None).cast("binary")
    resident = first.where("kind = 0").select("n", "cell", "block", "keys", none.alias("numbers"), "vectors", none.alias("leasts"), F.lit(False).alias("query"))

    def solve(batches: Iterator[pa.RecordBatch]):
        group, keys, x = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                own = np.frombuffer(r["keys"], dtype="<i8"), _vectors(r["vectors"], r["n"])
                if not r["query"]:  # a block comes before its queries
                    group, (keys, x) = (r["n"], r["cell"], r["block"]), own
                elif group == (r["n"], r["cell"], r["block"]):
                    least, numbers = (np.frombuffer(r[c], dtype="<i8") for c in ("leasts", "numbers"))
                    q, c, s = best(*own, keys, x, k, least)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(own[0][q]), pa.array(c), pa.array(s)], names=["number", "query_id", "key", "score"])

    met = resident.unionByName(sent).repartition("n", "cell", "block").sortWithinPartitions("n", "cell", "block", "query")
    found = met.mapInArrow(tidied(solve), "number long, query_id long, key long, score long")
    asks = first.where("kind = 1").select("number", "query_id", F.explode("own").alias("own"))
    found = found.unionByName(asks.select("number", "query_id", "own.key", "own.score"))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i]))::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id % {EVERY} = 0 AND d.vec_id <> q.vec_id AND len(d.v) = len(q.v)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
    """

QUERIES = {"op9_top_k": op9_top_k}
ORACLES = {"op9_top_k": ORACLE}
