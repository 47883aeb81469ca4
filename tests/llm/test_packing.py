import functools
import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import packing as p


def fewest(items, cap):
    n = len(items)
    sums = [sum(items[i] for i in range(n) if m >> i & 1) for m in range(1 << n)]
    fits = [m for m in range(1, 1 << n) if sums[m] <= cap]

    @functools.cache
    def need(m):
        return 0 if not m else 1 + min(need(m & ~x) for x in fits if x & (m & -m) and x & m == x)

    return need((1 << n) - 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_plan_is_optimal_on_small_cases(items):
    counts = np.bincount(items, minlength=21)
    plan = p.plan(counts, 20)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 20
        for x in pattern:
            used[x] += times
    assert used == Counter(items)
    assert sum(n for _, n in plan) == fewest(tuple(items), 20) >= p.lower_bound(counts, 20)


def test_search_beats_the_incumbent():
    for items, fit, best in (([6, 5, 5, 4, 4, 3, 3], 3, 3), ([6, 5, 3, 2, 2, 2], 3, 2)):
        counts = np.bincount(items, minlength=11)
        assert (sum(n for _, n in p.best_fit(counts, 10)), sum(n for _, n in p.plan(counts, 10))) == (fit, best)


def test_domination():
    assert p._dominates((7,), (4, 3)) and not p._dominates((4, 3), (7,))
    assert p.completions(7, np.bincount([7, 4, 3], minlength=8), 100) == [(7,)]


def test_cuts():
    assert p.cuts(5, 5) == [(0, 5)]
    assert p.cuts(12, 5) == [(0, 2), (2, 5), (7, 5)]
    assert p.cuts(10, 5) == [(0, 5), (5, 5)]


def test_places_are_gapless_and_hold_the_ids(spark):
    from tokenizers import Tokenizer

    random.seed(3)
    words = ["alpha", "beta", "gamma", "é", "x" * 30]
    texts = [" ".join(random.choices(words, k=random.randint(0, 60))) for _ in range(40)] + [None, "", "<|endoftext|> a", "word " * 3000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, texts[3], "clash", 1), (None, "null id", "c", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, offset int")
    out = p.pack_documents(docs, capacity=64, with_ids=True).collect()
    slow = Tokenizer.from_file(p._file(p.VOCABULARY))
    want = Counter()
    for k, t, *_ in rows:
        ids = slow.encode(t or "", add_special_tokens=False).ids + [0]
        for i, (s, n) in enumerate(p.cuts(len(ids), 64)):
            want[k, i, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in out)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    total = sum(r.length for r in out)
    assert len(by) == -(-total // 64)
    assert {(r.n_sequences, r.least_sequences) for r in out} == {(len(by), len(by))}


def test_a_search_that_ends_early_says_so(spark, monkeypatch):
    """Pieces of 6, 5, 3, 2, 2, 2 into 10: best fit puts 6 and 3 together, and needs a third sequence."""
    items = spark.createDataFrame([(i, n) for i, n in enumerate([6, 5, 3, 2, 2, 2])], "key long, length long")
    assert {(r.n_sequences, r.least_sequences) for r in p.pack(items, capacity=10, order=("key",)).collect()} == {(2, 2)}
    full = p.plan
    monkeypatch.setattr(p, "plan", lambda counts, capacity: full(counts, capacity, 0))
    assert {(r.n_sequences, r.least_sequences) for r in p.pack(items, capacity=10, order=("key",)).collect()} == {(3, 2)}


def test_more_groups_for_more_pieces(spark, monkeypatch):
    monkeypatch.setattr(p, "GROUPS", 1)
    monkeypatch.setattr(p, "PER_GROUP", 7)
    items = spark.createDataFrame([(i, 1 + (i % 3 > 0) * 4) for i in range(200)], "key long, length long")
    out = p.pack(items, capacity=10, order=("key",)).collect()
    spots = Counter()
    for r in out:
        for at in range(r.offset, r.offset + r.length):
            spots[r.sequence_id, at] += 1
    assert len(out) == 200 and set(spots.values()) == {1} and len({s for s, _ in spots}) == -(-sum(r.length for r in out) // 10)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_named_library(text):
    global slow
    slow = globals().get("slow") or __import__("tokenizers").Tokenizer.from_file(p._file(p.VOCABULARY))
    assert p.encoder()(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_empty(spark):
    assert p.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_rows_are_dealt_to_all_groups(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "same text")] * 4000 + [(i, f"text {i}") for i in range(8000)], "doc_id long, text string")
    seen, full = [], p.pack
    monkeypatch.setattr(p, "pack", lambda items, length, capacity, order: seen.append((items, order)) or full(items, length, capacity, order))
    assert p.pack_documents(docs).count() == 12000
    items, order = seen[0]
    group = p.F.pmod(p.F.xxhash64(*order), p.F.lit(p.GROUPS))
    sizes = sorted(r["count"] for r in items.where(p.F.col("key") == 1).groupBy(group.alias("g")).count().collect())
    assert len(sizes) > p.GROUPS / 2 and sizes[-1] < 4 * max(4, sizes[len(sizes) // 2])
