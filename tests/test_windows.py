"""Common runs of words against a plain version, on repetitive texts, copies and very common lines."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import words
from lodestone.operators import clones, windows


def plain(texts, size):
    """Runs by listing every place where windows meet."""
    least = {}
    for k, t in texts:
        if t is not None:
            least[t] = min(k, least.get(t, k))
    at = defaultdict(list)
    for t, k in least.items():
        w = t.lower().split()
        for i in range(len(w) - size + 1):
            at[tuple(w[i : i + size])].append((k, i))
    met = {(a, b, i, j) for own in at.values() for a, i in own for b, j in own if a < b}
    out = []
    for a, b, i, j in met:
        if (a, b, i - 1, j - 1) not in met:
            n = 1
            while (a, b, i + n, j + n) in met:
                n += 1
            out.append((a, b, i, j, n + size - 1))
    return sorted(out), at


def test_runs_and_counts_equal_a_plain_version(spark, monkeypatch):
    rng = random.Random(5)
    line = " ".join(f"line{i}" for i in range(9))
    texts = []
    for k in range(40):
        own = [rng.choice("abc") for _ in range(rng.randrange(0, 60))]
        texts.append((k, " ".join([*own, line, *own[: rng.randrange(0, 20)], line] if k % 3 else own)))
    texts += [(100 + k, texts[k][1]) for k in range(0, 40, 5)] + [(200, "x " * 50), (201, "y " + "x " * 30), (202, None), (203, ""), (204, line.upper())]
    df = spark.createDataFrame(texts, "k long, t string")
    monkeypatch.setattr(windows, "PAIRS", 50)  # several parts, also within a text
    rows = lambda **o: sorted(tuple(r) for r in clones.token_clones(df, "k", "t", 5, **o).collect())
    want, at = plain(texts, 5)
    assert rows() == want
    best = {}
    for a, b, i, j, n in want:
        best[a, b] = min(best.get((a, b), (0, 0, 0)), (-n, i, j))
    assert rows(longest=True) == sorted((a, b, i, j, -n) for (a, b), (n, i, j) in best.items())
    docs = [len({k for k, _ in own}) for own in at.values()]
    got = {r.n_docs: r.n_windows for r in clones.shared_windows(df, "k", "t", 5).collect()}
    assert got == {n: docs.count(n) for n in set(docs) if n > 1}


def test_texts_of_one_block_meet_once(spark):
    """Pairs of a block of texts and an empty block have no runs: of few texts most blocks are empty."""
    shared = "b c d e f g h"
    for n in (2, 3, 5):
        df = spark.createDataFrame([(k, f"x{k} {shared} y{k}") for k in range(n)], "k long, t string")
        want = [(a, b, 1, 1, 7) for a in range(n) for b in range(a + 1, n)]
        for longest in (False, True):
            assert sorted(tuple(r) for r in clones.token_clones(df, "k", "t", 4, longest=longest).collect()) == want


def test_no_window_is_joined_and_no_run_is_shuffled(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "x b c d e y")], "k long, t string")
    for longest in (False, True):
        plan = clones.token_clones(df, "k", "t", 4, longest=longest)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Join") == 1 and plan.lstrip().startswith("FlatMapGroupsInArrow"), plan  # texts get their keys


def test_rolled_and_least_of():
    x = np.arange(1, 80, dtype=np.uint64) ** np.uint64(3)
    for n in (1, 2, 5, 13, 15, 30):
        h = windows.rolled(x, n)
        assert len(h) == len(x) - n + 1 and np.array_equal(h[7:], windows.rolled(x[7:], n)) and len(np.unique(h)) == len(h)
        assert windows.least_of(x[::-1], n).tolist() == [min(x[::-1][i : i + n]) for i in range(len(x) - n + 1)]


def test_values_are_made_once_for_texts_with_equal_shingles(monkeypatch):
    """Signatures equal the plain definition, however few different hashes are kept; of equal texts values
    are made once."""
    texts = ["the quick brown fox jumps", "the quick brown fox jumped over", "zażółć gęślą jaźń \U0001f600 x", "the quick brown fox jumps"]
    number = lambda s: sum(ord(c) * clones.BASE ** (4 - i) for i, c in enumerate(s)) % clones.PRIME
    sets = [{number(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = [[min((a * x + b) % clones.PRIME for x in s) for a, b in clones.COEFFICIENTS] for s in sets]
    hashes = [clones.shingle_hashes(t) for t in texts]
    assert [set(h.tolist()) for h in hashes] == sets
    made, real = [], clones.function_values
    monkeypatch.setattr(clones, "function_values", lambda h: made.append(len(h)) or real(h))
    assert [v.tolist() for v in clones.least_values(hashes)] == want
    assert sum(made) == len(set().union(*sets))
    for known, occur in ((30, 1000), (5, 1000), (1000, 1)):
        monkeypatch.setattr(clones, "KNOWN", known)
        monkeypatch.setattr(clones, "OCCUR", occur)
        assert [v.tolist() for v in clones.least_values(hashes)] == want


def test_sets_of_pairs_are_compared_where_their_texts_meet(spark, monkeypatch):
    """Sizes equal plain sets, also where groups are dealt in parts; no set is joined to a pair."""
    rng = random.Random(3)
    texts = {k: "".join(rng.choice("ab \U0001f600é") for _ in range(40)) for k in range(12)}
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    pairs = spark.createDataFrame([(a, b) for a in range(9) for b in range(a + 1, 9)] + [(9, 11), (10, 11)], "doc_a long, doc_b long")
    sets = {}
    for k, t in texts.items():
        t = " ".join(t.split())
        sets[k] = {t[i : i + 5] for i in range(len(t) - 4)}
    want = sorted((r.doc_a, r.doc_b, len(sets[r.doc_a] & sets[r.doc_b]), len(sets[r.doc_a] | sets[r.doc_b])) for r in pairs.collect())
    for together in (1024, 3):
        monkeypatch.setattr(clones, "TOGETHER", together)
        out = clones.exact_similarity(pairs, df, "k", "t")
        assert sorted(tuple(r) for r in out.collect()) == want
        assert out._jdf.queryExecution().sparkPlan().toString().lstrip().startswith("FlatMapCoGroupsInArrow")


def in_process(texts, size, longest):
    """The runs of texts of word numbers, in two blocks, and how many pairs of places of both blocks meet."""
    columns = []
    for t, w in enumerate(texts):
        w = np.array(w, dtype=np.uint64)
        at = np.arange(len(w) - size + 1)
        wide = np.concatenate([[0], w, [0]]).astype(np.uint64)
        columns.append((windows.rolled(w, size), np.zeros(len(at), "u4"), np.full(len(at), t), at.astype("i4"), wide[:-2][at], wide[at + size + 1]))
    ends = windows._ends(pa.table({"part": [0], **{f"c{i}": [windows._packed(np.concatenate(c))] for i, c in enumerate(zip(*columns))}}))
    block = ends.column("t").to_numpy() % 2
    ends = ends.append_column("key", ends.column("t")).append_column("block", pa.array(block.astype("i4")))
    rows = [windows._block(ends.filter(pa.array(block == b))) for b in (0, 1)]
    out = []
    for lo, hi in ((0, 0), (0, 1), (1, 1)):
        both = pa.concat_tables([rows[b] for b in {lo, hi}])
        for b in windows._runs(both.append_column("pair", pa.array(np.full(len(both), 2 * lo + hi, "i4"))).to_batches(), size, longest, 2):
            out += [tuple(r.values()) for r in b.to_pylist()]
    g, before = (ends.column(c).to_numpy() for c in ("g", "before"))
    met = windows._met(*(np.flatnonzero((before >= 0) & (block == b)) for b in (0, 1)), g, before)[-1]
    return sorted(out), met.sum()


def test_places_with_equal_words_before_them_do_not_meet(monkeypatch):
    """Of n and m repeats of a line some n + m begin runs; the n * m places where it meets are not listed."""
    line = list(range(1, 8))
    texts = [[90, *line * 40, 91], [92, *line * 50, 93], [*line * 30], [94, *line * 3, 95, *line * 3]]
    want, _ = plain([(k, " ".join(map(str, w))) for k, w in enumerate(texts)], 5)
    best = {}
    for a, b, i, j, n in want:
        best[a, b] = min(best.get((a, b), (0, 0, 0)), (-n, i, j))
    for levels, packed in ((8, 1 << 17), (2, 20)):  # few spans, small packs
        monkeypatch.setattr(windows, "LEVELS", levels)
        monkeypatch.setattr(windows, "PACKED", packed)
        got, met = in_process(texts, 5, False)
        assert got == want and met == sum((a + b) % 2 for a, b, *_ in want)
        assert in_process(texts, 5, True)[0] == sorted((a, b, i, j, -n) for (a, b), (n, i, j) in best.items())


def test_words_are_split_as_the_column_function_does(spark, monkeypatch):
    monkeypatch.setattr(windows, "SLICE", 16)  # also a word that is longer
    rng = random.Random(7)
    texts = ["", " ", "a", "a b", " a\tb\n\nc\r\fd ", "x" * 50, "é é \x0b y z", "b" * 15 + " " + "c" * 16, "\U0001f600 a"]
    texts += ["".join(rng.choice("ab \n\té") for _ in range(rng.randrange(60))) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", words(F.col("t")).alias("w"))
    want = [r.w for r in df.orderBy("i").collect()]
    for most in (1 << 22, 10):
        monkeypatch.setattr(windows, "BYTES", most)
        found = [(first, x, ends) for first, x, ends in windows._words(pa.array(["no", *texts])[1:])]
        got = [x[ends[i] : ends[i + 1]].tolist() for _, x, ends in found for i in range(len(ends) - 1)]
        assert [len(x) for x in got] == [len(x) for x in want] and [f for f, _, _ in found] == sorted({f for f, _, _ in found})
        pairs = {(h, w) for x, y in zip(got, want) for h, w in zip(x, y)}
        assert len(pairs) == len({h for h, _ in pairs}) == len({w for _, w in pairs})
