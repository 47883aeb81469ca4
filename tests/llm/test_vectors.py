import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import neardup, topk

ODD = [
    (0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [1.0]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [2.0, 4.0]),
    (6, [1.0, 2.0]), (7, [3.0, 1.0]), (None, [1.0, 1.0]), (8, [9.0]), (9, [0.0, 0.0]), (10, [float("inf"), 1.0]), (100, [-1.0, -2.0]),
]


def good(v, zero=True):
    return v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def plain_links(rows, t):
    own = [(k, np.array(v)) for k, v in rows if k is not None and good(v, False)]
    n, links, root = len(own), [0] * len(own), list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            x, y = own[i][1], own[j][1]
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= t:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), own[i][0]), own[i][0])
    out = [(own[i][0], links[i], least[find(i)]) for i in range(n)]
    return sorted(out + [(k, 0, k) for k, v in rows if k is None or not good(v, False)], key=str)


def family(seed=1, n=300, dim=6):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=dim).tolist()) for i in range(n)]
    centre = rng.normal(size=dim)
    rows += [(1000 + i, (centre + 0.12 * rng.normal(size=dim)).tolist()) for i in range(n)]
    return rows + [(2000 + i, rows[3][1]) for i in range(40)]


@pytest.mark.parametrize("rows", [ODD, family()])
@pytest.mark.parametrize("block", [2048, 16])
def test_links_equal_all_pairs(spark, monkeypatch, rows, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "CODES", max(2, block // 4))
    monkeypatch.setattr(neardup, "PIECE", max(2, block // 16))
    monkeypatch.setattr(neardup, "FAN", 4)
    df = spark.createDataFrame([(k, v, "c") for k, v in rows], "vec_id long, embedding array<double>, n string")
    out = neardup.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str) == plain_links(rows, 0.95)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


@pytest.mark.parametrize("axes", [2, 24])
def test_links_of_crowds_equal_all_pairs(spark, monkeypatch, axes):
    """A crowd of different vectors in one spot, and vectors of many more components than a code has."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    monkeypatch.setattr(neardup, "PIECE", 16)
    monkeypatch.setattr(neardup, "AXES", axes)
    monkeypatch.setattr(neardup, "GRID", 2)
    monkeypatch.setattr(neardup, "_SIDES", ["lo0", "lo1", "hi0", "hi1"])
    names = [("part", pa.int32()), ("nth", pa.int64()), ("n", pa.int32()), *[(c, pa.float64()) for c in neardup._SIDES], ("nodes", pa.binary()), ("codes", pa.binary())]
    monkeypatch.setattr(neardup, "_BLOCKS", pa.schema(names))
    monkeypatch.setattr(neardup, "_BLOCKS_DDL", "part int, nth long, n int, lo0 double, lo1 double, hi0 double, hi1 double, nodes binary, codes binary")
    rng = np.random.default_rng(11)
    spot = rng.normal(size=40)
    rows = [(i, (spot + 0.02 * rng.normal(size=40)).tolist()) for i in range(150)]
    rows += [(1000 + i, (spot + 0.23 * rng.normal(size=40)).tolist()) for i in range(100)]
    rows += [(2000 + i, rng.normal(size=40).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neardup.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str) == plain_links(rows, 0.95)


def test_codes_never_hide_a_link():
    rng = np.random.default_rng(12)
    spots = neardup.unit(rng.normal(size=(40, 64)))
    x = neardup.unit(spots[rng.integers(0, 40, 800)] + 0.027 * rng.normal(size=(800, 64)))
    half = neardup.codes(x, {64: neardup.principal(x, neardup.AXES)}).astype("<f2").astype(np.float32)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    rows, cols = neardup.possible(half, half, 0.95, True)
    assert 100 < hit.any(1).sum() < 800 and (hit.any(1) <= rows | cols).all()
    rows, cols = neardup.possible(half[:300], half[300:], 0.95, False)
    assert (hit[:300, 300:].any(1) <= rows).all() and (hit[:300, 300:].any(0) <= cols).all()


def test_interval_pairs_equal_all_pairs_of_boxes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FAN", 3)
    rng = np.random.default_rng(13)
    low = np.sort(rng.normal(size=(50, neardup.GRID)), axis=0)
    high = low + 0.2 * rng.random(size=low.shape)
    rows = [(i, 2 if i < 30 else 3, *low[i].tolist(), *high[i].tolist()) for i in range(50)]
    blocks = spark.createDataFrame(rows, "seq long, n int, " + ", ".join(f"{c} double" for c in neardup._SIDES))
    got = {(r.a, r.b) for r in neardup.interval_pairs(blocks, 50, 0.9).collect()}
    gap = np.maximum(0, np.maximum(low[:, None] - high[None], low[None] - high[:, None]))
    near = (gap * gap).sum(2) <= 0.81
    want = {(i, j) for i in range(50) for j in range(i, 50) if near[i, j] and (i < 30) == (j < 30)}
    assert got == want and len(want) < 600


def test_cosine_at_the_threshold():
    x = np.array([[3.0, 4.0]]) / 5
    y = np.array([[1.0, 0.0]])
    assert neardup.cosine_at_least(x, y, 0.6).all() and not neardup.cosine_at_least(x, y, 0.6 + 1e-9).any()


def plain_top(rows, k, every):
    own = [(a, [math.floor(256 * x) for x in v]) for a, v in rows if a is not None and good(v)]
    out = []
    for i, (a, x) in enumerate(own):
        if a % every == 0:
            found = sorted((-sum(p * q for p, q in zip(x, y)), b) for b, y in own if b != a and len(x) == len(y))
            out += [(a, r + 1, b, -s) for r, (s, b) in enumerate(found[:k])]
    return sorted(out)


def test_top_k_equals_all_scores(spark, monkeypatch):
    once = [r for r in ODD if r != (0, [1.0, 2.0])] + [(0, [1.0, 2.0])]
    for rows, room, cell in ((family(2), 8 << 20, 4096), (family(3), 400, 20), (once, 8 << 20, 4096), (family(4), 48, 300)):
        df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, score int")
        out = topk.top_k(df, block_bytes=room, per_cell=cell).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == plain_top(rows, 5, 50)


@pytest.mark.parametrize(("room", "cell"), [(8 << 20, 4096), (400, 20)])
def test_repeated_query_rows_are_answered_each(spark, room, cell):
    rng = np.random.default_rng(7)
    far = [(50, (20 + rng.normal(size=6)).tolist()) for _ in range(4)]
    # A third of the rows are one query's, in a cell of their own.
    many = [(i + 1, rng.normal(size=6).tolist()) for i in range(200)] + [(1000, [9.0] * 6)] * 100
    for rows in (ODD, family(2) + far, many):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        out = topk.top_k(df, block_bytes=room, per_cell=cell).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == plain_top(rows, 5, 50)


def shares(spark, df, cells, room):
    """Of all pairs of a query and a block but its own, how many the query is copied for."""
    ints = topk.integers(df, "vec_id", "embedding").withColumn("number", F.monotonically_increasing_id()).cache()
    known = topk.pivots(ints, cells)
    rows = {(n, c): 0 for n in known for c in range(len(known[n]))}
    for r in ints.select("v").collect():
        rows[len(r.v), int(topk._cells(np.array([r.v]), known[len(r.v)])[0])] += 1
    first = topk.first_pass(ints, known, {c: max(1, -(-m // room)) for c, m in rows.items()}, 50, 5)
    summary = topk.cell_summaries(first)
    sent = sum(len(r["keys"]) // 8 for r in topk.copies(first, known, summary).collect())
    blocks, queries = first.where("kind = 0").count(), first.where("kind = 1").count()
    return sent / (queries * (blocks - 1)), first


def test_bounds_prune(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 32)) * 2
    rows = [(i, (centres[i % 16] + 0.3 * rng.normal(size=32)).tolist()) for i in range(3200)]
    share, first = shares(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 16, 300)
    assert share < 0.2
    assert all(len(r.own) == 5 and r.least == r.own[-1].score for r in first.where("kind = 1").collect())


def test_a_cell_is_passed_over_only_if_it_holds_nothing_better():
    rng = np.random.default_rng(8)
    p = np.round(rng.normal(size=(6, 4)) * 50)
    cells = [np.round(c + rng.normal(size=(30, 4)) * r) for c, r in zip(p, (1, 3, 9, 27, 0, 5))]
    q = np.round(rng.normal(size=(200, 4)) * 80)
    radius = np.array([np.sqrt(((c - o) ** 2).sum(1).max()) for c, o in zip(cells, p)])
    norm = np.array([np.sqrt((c * c).sum(1).max()) for c in cells])
    top = np.array([(q @ c.T).max(1) for c in cells]).T
    for least in (top.max(1), top.min(1), top[:, 0]):
        may = topk.reachable(q, least.astype(np.int64), p, radius, norm)
        assert (may | (top < least[:, None])).all()
    assert not topk.reachable(q, top.max(1).astype(np.int64) + 1, p, radius, norm)[:, 4].any()


def test_large_scores_are_exact_or_refused():
    q = np.array([[2.0**30 + 1, 3.0]])
    assert topk._scores(q, q)[0, 0] == (2**30 + 1) ** 2 + 9
    with pytest.raises(ValueError, match="range"):
        topk._scores(q * 2.0**10, q * 2.0**10)


def test_long_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i * 10, rng.normal(size=30_000).tolist()) for i in range(12)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_bytes=1 << 20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == plain_top(rows, 5, 50)


def test_oracle(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(duckdb.sql(topk.ORACLE).fetchall())
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.op9_top_k(spark, sf).collect()) == want


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none).count() == neardup.near_duplicates(none).count() == 0
