import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pieces as p


def paths(word, v):
    """The probability of each segmentation, by listing all."""
    log = {int(i): float(w) for i, w in zip(v.ids, v.log) if i >= 0}
    by = {}
    for i in log:
        by.setdefault(v.raw[i].decode(), []).append(i)
    out = {}

    def go(at, ids, w):
        if at == len(word):
            out[tuple(ids)] = w
        for n in range(1, len(word) - at + 1):
            for i in by.get(word[at : at + n], ()):
                go(at + n, [*ids, i], w + log[i])

    go(0, [], 0.0)
    total = sum(map(math.exp, out.values()))
    return {k: math.exp(w) / total for k, w in out.items()}


def test_samples_follow_the_weights():
    v = p.vocabulary(cost=1.0)
    n = 40_000
    want = paths(" hello", v)
    got = Counter(tuple(x.tolist()) for x in p.encode(["hello"] * n, np.arange(n), v))
    assert set(got) <= set(want) and len(got) > 10
    assert max(abs(got[k] / n - w) for k, w in want.items()) < 0.01


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_decoding_is_lossless(texts):
    v = p.vocabulary()
    ids = p.encode(texts, np.arange(len(texts)), v)
    assert [v.decode(i.tolist()) if t else "" for t, i in zip(texts, ids)] == texts


def test_seed_and_key_alone_decide():
    v = p.vocabulary(cost=1.0)
    texts = ["the same text again", "another one", "the same text again"]
    a = p.encode(texts, np.array([5, 6, 5]), v)
    b = p.encode(texts[::-1], np.array([5, 6, 5]), v)
    assert (a[0] == a[2]).all() and (a[0] == b[0]).all() and (a[1] == b[1]).all()
    many = {tuple(p.encode([texts[0]], np.array([k]), v, seed=s)[0].tolist()) for k in range(8) for s in range(3)}
    assert len(many) > 5


def test_rows(spark):
    texts = ["", "a", "  two  blanks ", "▁literal ▁▁", "é€😀\n\ttab", "x" * 20_000, " " * 300, "日本語", "a\0b", None, "word " * 20_000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(1, "a", 0), (None, "b", 0)], "doc_id long, text string, ids int")
    out = p.encoded(df)
    assert all(r.lossless for r in out.collect() if r.doc_id != 9)
    back = {r.doc_id: r.text for r in p.decoded(out).collect()}
    assert [back[i] for i in range(len(texts))] == texts and back[None] == "b"
    assert p.encoded(df.limit(0)).count() == 0
