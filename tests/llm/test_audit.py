import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from lodestone.llm import audit as a


def fails(rows):
    """The failed filters of each (doc_id, text, lang) as a string."""
    out = []
    for key, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        own = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(set(t) & set("#$%&*|"))
        same = [k for k, u, _ in rows if k is not None and (u or "") == t]
        out.append(own + "E" * (key is not None and min(same) < key))
    return out


def plain(rows, labels):
    """The audit by walking every document through every order."""
    good, toxic = ({k for k, *x in labels if k is not None and x[i] == 1} for i in (0, 1))
    out = {(p, "".join(o), s): Counter() for p in {lang or "" for _, _, lang in rows} for o in permutations("ABCDE") for s in range(1, 6)}
    for (key, _, lang), bad in zip(rows, fails(rows)):
        for o in permutations("ABCDE"):
            gone = False
            for s, f in enumerate(o, 1):
                c = out[lang or "", "".join(o), s]
                if f in bad:
                    c["redundant"] += gone
                    c["unique_fails"] += bad == f
                    if not gone:
                        c["removed"] += 1
                        c["good_lost"] += key in good
                        c["toxic_lost"] += key in toxic
                    gone = True
                c["kept"] += not gone
    total = Counter()
    for (p, o, s), c in out.items():
        total[p, o[s - 1]] += c["removed"]
    return sorted((*k, *[c[x] for x in a.COUNTS], total[k[0], k[1][k[2] - 1]]) for k, c in out.items())


def made(n, seed=1):
    rng = random.Random(seed)
    texts = [None, "", " \t", "A" * 99, "#", "word " * 200, " ".join(f"w{i}" for i in range(150)), " ".join(["x"] * 120)]
    texts += [" ".join(f"v{rng.randint(0, 300)}" for _ in range(rng.randint(90, 140))) + rng.choice(["", "", " 5%", " LOUD" * 40]) for _ in range(12)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(n)]
    rows += [(3, "x", "en"), (3, "y", "en"), (None, "x", "fr"), (None, None, None), rows[5], rows[5]]
    labels = [(rng.randrange(n), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)] + [(None, 1, 1), (10**6, 1, 1)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, failed int, part string")
    return docs, spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, part string")


def test_audit_equals_a_walk_through_every_order(spark):
    rows, labels = made(70)
    out = a.filter_audit(*frames(spark, rows, labels))
    assert out.columns == ["part", "filter_order", "step", *a.COUNTS, "shapley"]
    assert sorted(tuple(r) for r in out.collect()) == plain(rows, labels)


def test_heavy_texts_are_broadcast_and_the_rest_joined(spark):
    rows = [(i, "hot" if i % 3 == 0 else "warm" if i % 50 == 1 else f"t {i}", "en") for i in range(600)]
    docs, _ = frames(spark, rows, [(0, 1, 1)])
    out = a.with_copies(a.failed_by_text(docs))
    assert {r.key for r in out.where(F.col("failed") >= 16).collect()} == {k for (k, *_), bad in zip(rows, fails(rows)) if "E" in bad}
    assert out.count() == len(rows)


def test_empty_tables_and_no_labels(spark):
    docs, labels = frames(spark, [(1, "x", "en")], [(1, 1, 1)])
    assert a.filter_audit(docs.limit(0), labels).count() == 0
    rows = a.filter_audit(docs, labels.limit(0)).collect()
    assert len(rows) == 600 and not any(r.good_lost or r.toxic_lost for r in rows)


def test_long_texts_are_read_whole(spark):
    rows = [(1, "a b " * 300_000 + "$", "en"), (2, "a b " * 300_000, "en")]
    docs, _ = frames(spark, rows, [(1, 1, 1)])
    assert [r.failed for r in a.with_copies(a.failed_by_text(docs)).orderBy("key").collect()] == [2 + 8, 2]


def test_orders_are_the_120_permutations(spark):
    rows = a.orders(spark).collect()
    assert len(rows) == len({r.filter_order for r in rows}) == 120
    assert all([1 << "ABCDE".index(f) for f in r.filter_order] == r.bits for r in rows)
