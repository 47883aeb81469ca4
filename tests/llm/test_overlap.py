import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import overlap as o
from lodestone.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    """doc_id -> (shingles, component) by all pairs."""
    sets = [(k, sets_of(t)) for k, t in rows]
    root = {k: k for k, _ in sets if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= 80 * len(x | y):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return sorted(((k, len(s), None if k is None else find(k)) for k, s in sets), key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉé \t\n\x0b\x1c ", max_size=40), max_size=8))
def test_shingles_equal_the_words(texts):
    got = o.shingle_sets([t.encode() for t in texts])
    assert [len(x) for x in got] == [len(sets_of(t)) for t in texts]


def test_hashes_do_not_depend_on_the_place():
    text = "some words that stand here at first"
    alone, after = o.shingle_sets([text.encode()])[0], o.shingle_sets([b"x" * 99, text.encode()])[1]
    assert (alone == after).all()


def test_overlaps_equal_set_products():
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.integers(0, 9000, 700)) for _ in range(n)] for n in (7, 5))
    cells = lambda s: (np.repeat(np.arange(len(s)), [len(x) for x in s]), np.concatenate(s).astype(np.uint64))
    want = [[len(set(x) & set(y)) for y in b] for x in a]
    assert o.overlaps(cells(a), cells(b)).tolist() == want


def corpus(seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    passage = random.choices(words, k=60)
    for f in range(12):
        base = random.choices(words, k=random.choice([4, 30, 120, 300]))
        for _ in range(random.choice([1, 2, 25])):
            own = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 25))):
                own[random.randrange(len(own))] = random.choice(words)
            rows.append(" ".join(own))
    rows += [" ".join(passage + random.choices(words, k=random.randint(5, 40))) for _ in range(60)]
    rows += [rows[0]] * 30 + [rows[0].upper(), "", " \n", None, None, "one", "one", "One two", "five words are just enough", "x " * 5000]
    random.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_all_pairs(spark, monkeypatch):
    for seed, rows_in_block in ((1, 256), (2, 4)):
        monkeypatch.setattr(o, "ROWS", rows_in_block)
        monkeypatch.setattr(o, "HOT", 2 * rows_in_block)
        rows = [*corpus(seed), (None, "five words are just enough"), (5, "a repeated id and other text here")]
        df = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, n string, set int")
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in o.ngram_jaccard(df).collect()), key=str)
        if seed == 1:
            assert got == plain(rows)
        else:
            assert got == plain(rows)


def test_a_shingle_in_all_rows(spark, monkeypatch):
    """Limits so low that columns are set apart, blocks pass the rows of a packed cell, and columns the
    entries that one task holds."""
    random.seed(9)
    words = [f"w{i}" for i in range(400)]
    common = "all of these rows begin with the same twelve words in the same order here"
    rows = []
    for i in range(60):
        own = random.choices(words, k=2)
        rows += [f"{common} {' '.join(own)}", f"{common} {own[0]}"]
        if i % 3 == 0:
            own = random.choices(words, k=60)
            rows += [f"{common} {' '.join(own)}", f"{common} {' '.join(own[:-2])} other end"]
    rows = list(enumerate(rows + rows[:5]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    for bits, chunk, apart in ((24, 1024, 65536), (3, 4, 65536), (3, 4, 3), (24, 1024, 0)):
        monkeypatch.setattr(o, "ROW_BITS", bits)
        monkeypatch.setattr(o, "CHUNK", chunk)
        monkeypatch.setattr(o, "ROWS", 4)
        monkeypatch.setattr(o, "HOT", 4)
        if apart != 65536:
            monkeypatch.setattr(o, "frequent", lambda d, w, n, f=o.frequent, apart=apart: f(d, w, n)[:apart])
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in o.ngram_jaccard(df).collect()), key=str)
        assert got == want
        monkeypatch.undo()
    assert len(o.frequent(df.withColumnRenamed("doc_id", "key"), 5, len(rows))) >= 10


def test_counted_cells_do_not_depend_on_the_way(monkeypatch):
    rng = np.random.default_rng(2)
    tokens, row = rng.integers(0, 50, 2000).astype(np.uint64), rng.integers(0, 30, 2000)
    one = o._counted(tokens.copy(), row.copy(), 30)
    monkeypatch.setattr(o, "ROW_BITS", 2)
    two = o._counted(tokens.copy(), row.copy(), 30)
    assert all((a == b).all() for a, b in zip(one, two)) and len(one[0]) == len({*zip(tokens.tolist(), row.tolist())})


def test_more_column_blocks_for_more_text(spark, monkeypatch):
    monkeypatch.setattr(o, "BLOCK_TEXT", 1000)
    rows = corpus(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in o.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain(rows)


def test_exact_bound(spark):
    # 9 of 11 shingles shared is over 80 %, 8 of 10 exactly, 7 of 9 below.
    a = [f"a{i}" for i in range(20)]
    for tail, linked in ((1, True), (2, True), (3, True), (4, False)):
        rows = [(1, " ".join(a)), (2, " ".join(a[:-tail] + [f"z{i}" for i in range(tail)]))]
        x, y = sets_of(rows[0][1]), sets_of(rows[1][1])
        out = {r.doc_id: r.component_id for r in o.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert (out[2] == 1) == (100 * len(x & y) >= 80 * len(x | y))


def test_empty(spark):
    assert o.ngram_jaccard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0
