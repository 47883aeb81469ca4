import math
import random
import re
import zlib

import numpy as np
from lodestone.llm import toxicity as t


def corpus(n=900):
    random.seed(5)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    bad = ["nasty", "vile", "rotten", "scummy"]
    rows, labels = [], []
    for i in range(n):
        own = random.choices(words, k=random.randint(5, 60))
        toxic = i % 7 == 0
        for _ in range(3 * toxic):
            own.insert(random.randrange(len(own)), random.choice(bad))
        rows.append((i, " ".join(own)))
        if i % 2 or toxic and i % 3:
            labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_cases(spark):
    rows, labels = corpus()
    extra = [(5000, None), (5001, ""), (None, "vile nasty rotten"), (3, rows[3][1]), (5002, "nasty vile " * 20_000)]
    docs = spark.createDataFrame([(k, x, "c") for k, x in [*rows, *extra]], "doc_id long, text string, label string")
    known = spark.createDataFrame([*labels, (None, 1), (7, None), (99_999, 1)], "doc_id long, toxic int")
    out = t.toxicity(docs, known).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in out)
    score = {r.doc_id: r.score for r in out}
    held = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 4 == 2]
    good = [score[i] for i in held if i % 7 == 0], [score[i] for i in held if i % 7]
    assert np.mean([a > b for a in good[0] for b in good[1]]) > 0.97
    assert score[5000] == score[5001] < 0.3 < score[5002]
    assert score[None] > 0.3


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, y in labels]
    one, two = (t.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert one == two


def test_risk_correction():
    """With the positives among the unlabelled, the corrected risk still keeps noise words low."""
    rng = np.random.default_rng(0)
    rows = lambda n, p: [np.flatnonzero(np.r_[rng.random(1) < p, rng.random(30) < 0.1]) for _ in range(n)]
    w, b = t.train(t._Rows(rows(200, 0.95), 31), t._Rows(rows(180, 0.0) + rows(20, 0.95), 31), 0.1)
    assert w[0] > 2 and abs(w[1:]).max() < w[0] / 2 and b < 0


def plain_risk(positive, unlabelled, w, b, prior):
    """(risk of calling positives toxic, risk of calling texts clean), text by text."""
    z = lambda row: b + sum(w[i] for i in row)
    mean = lambda rows, loss: sum(loss(z(r)) for r in rows) / len(rows)
    toxic, clean = lambda x: math.log1p(math.exp(-x)), lambda x: math.log1p(math.exp(x))
    return prior * mean(positive, toxic), mean(unlabelled, clean) - prior * mean(positive, clean)


def test_steps_follow_the_risk():
    rng = np.random.default_rng(3)
    rows = lambda n: [np.flatnonzero(rng.random(5) < 0.5) for _ in range(n)]
    p, u, w, b, prior = rows(9), rows(30), rng.normal(size=5), 0.3, 0.2
    for scale, first in ((1, True), (1, False)):
        # With texts that look cleaner than the positives' share allows, the clean risk is negative.
        b = 0.3 if first else -3.0
        prior = 0.2 if first else 0.9
        w = w if first else np.abs(w) * 3
        un = u if first else [np.zeros(0, dtype=int)] * 30
        risk = lambda w, b, un=un, prior=prior: plain_risk(p, un, w, b, prior)
        assert (risk(w, b)[1] >= 0) == first
        value = (lambda w, b: sum(risk(w, b))) if first else (lambda w, b: -risk(w, b)[1])
        h = 1e-6
        want = [(value(w + h * e, b) - value(w - h * e, b)) / (2 * h) for e in np.eye(5)] + [(value(w, b + h) - value(w, b - h)) / (2 * h)]
        got = t.slope(t._Rows(p, 5), t._Rows(un, 5), w, b, prior, 0.0)
        assert np.allclose(got, want, atol=1e-6)


def test_vocabulary_and_scores_equal_a_plain_version(spark):
    rows, labels = corpus(500)
    rows += [(9000, "vile " + "y" * 300_000), (9001, None)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    learn = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    positive = {i for i, y in labels if y == 1 and i in learn}
    features = lambda x: {f for w in re.findall(r"\w+", (x or "").lower()) for f in [w[:40] + "$", *[w[:n] for n in (4, 5, 6) if len(w) > n]]}
    p, u = ({}, {})
    for i, x in rows:
        for f in features(x) if i in learn else ():
            u[f] = u.get(f, 0) + 1
            p[f] = p.get(f, 0) + (i in positive)
    n, m = len(positive), len(learn)

    def gain(f):
        if p[f] * m < u[f] * n:
            return -1
        part = lambda x, k: x * math.log(x * (n + m) / ((p[f] + u[f]) * k))
        return 2 * (part(p[f], n) + part(u[f], m))

    want = sorted(f for f in p if p[f] >= 3 and gain(f) >= t.LEAST_GAIN)
    sampled, prior = t.sample(docs, known, "doc_id", "text", "toxic")
    assert sorted(t.vocabulary(sampled, docs, "doc_id", "text")) == want
    of = [y for i, y in labels if i in learn]
    assert abs(prior - (sum(of) + 1) / (len(of) + 10)) < 1e-12
    weights, bias = t.fit(docs, known)
    assert set(weights) == set(want)
    for r in t.score(docs, weights, bias).collect():
        z = bias + sum(weights.get(f, 0) for f in features(r.text))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_bias_is_lowered_to_the_prior():
    z = np.random.default_rng(1).normal(size=500)
    off = t.excess(z, 0.1)
    assert abs((1 / (1 + np.exp(off - z))).mean() - 0.1) < 1e-9 and t.excess(z - 5, 0.1) == 0 == t.excess(z[:0], 0.1)


def test_clean_labels_are_never_learnt_from(spark):
    """Which documents are labelled clean does not matter, only how many."""
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    outside = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2 and i % 7]
    toxic = [(i, 1) for i, y in labels if y]
    one, two = (t.fit(docs, spark.createDataFrame(toxic + [(i, 0) for i in own], "doc_id long, toxic int")) for own in (outside[:60], outside[-60:]))
    assert one == two


def test_without_positives_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in t.toxicity(docs, none).collect()] == [0.0]
    assert t.toxicity(docs.limit(0), none).count() == 0


def test_counts_cover_all_documents(spark, monkeypatch):
    """A toxic word too rare for the sample of unlabelled texts, and one of a corpus whose labels give
    a wrong prior, are features all the same."""
    monkeypatch.setattr(t, "UNLABELLED", 40)
    random.seed(6)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(random.choices(words, k=30) + ["scummy"] * (i % 50 == 0))) for i in range(3000)]
    labels = [(i, int(i % 50 == 0)) for i in range(3000) if i % 100 == 0 or i % 25 == 1]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    weights, _ = t.fit(docs, known)
    assert weights["scummy$"] > 0
    kept = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 4 != 2]
    counts, texts = t.corpus_counts(docs.union(docs.limit(0)), ["scummy$", "worta", "none$"], "doc_id", "text")
    assert texts == len(kept) and counts[0] == sum(i % 50 == 0 for i in kept) and counts[2] == 0
    assert counts[1] == sum(any(w.startswith("worta") for w in rows[i][1].split()) for i in kept)


def test_words_and_features_equal_plain_ones():
    """Texts of ASCII letters alone are split in another way than others, with the same words."""
    import re

    random.seed(8)
    signs = [chr(i) for i in range(128)] + list("äßİ  ٣_") + ["word"] * 40 + ["x" * 60]
    texts = ["", "".join(signs), "".join(map(chr, range(128)))] + ["".join(random.choices(signs, k=random.randint(1, 60))) for _ in range(500)]
    plain = [set(re.findall(r"\w+", x.lower())) for x in texts]
    assert [t.words(x) for x in texts] == plain
    everything = sorted({f for own in plain for w in own for f in t.described(w)})
    known = set(everything[::2])
    for x, own in zip(texts, plain):
        found = t.features(x, t.lookup(known))
        assert len(found) == len(set(found)) and set(found) == {f for w in own for f in t.described(w)} & known
