"""The stored indexes and the log that they and the graph store are made of."""

import math
import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import clones
from lodestone.operators.log import Change, Conflict, Kept, TableLog
from lodestone.operators.lsh import LshIndex
from lodestone.operators.search import B, DIGITS, K1, TextIndex

TEXTS = {
    "a": "the quick brown fox jumps over the lazy dog near the river bank",
    "b": "the quick brown fox jumps over the lazy dog near the river banks",
    "c": "pack my box with five dozen liquor jugs and send them home",
    "d": "pack my box with five dozen liquor jugs and send them away",
    "e": "nothing of this is like the rest at all",
    "f": "",
}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "key string, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


@pytest.fixture
def log(spark, tmp_path):
    return TableLog(spark, str(tmp_path / "log"), {"t": Kept("part INT, key STRING, v INT", ("part", "key"), ("part",)), "u": Kept("key STRING, v INT", ("key",))})


def test_log_keeps_versions_and_refuses_late_writers(spark, log):
    rows = lambda n, v: spark.createDataFrame([(i % 4, f"k{i}", v) for i in range(n)], "part int, key string, v int")
    state = lambda s: {(r.part, r.key): r.v for r in s.read("t").collect()}
    assert log.version == -1 and state(log.snapshot()) == {}
    log.snapshot().commit(Change(put={"t": rows(200, 1)}))
    first = log.snapshot()
    log.snapshot().commit(Change(put={"t": rows(3, 2)}, gone={"t": rows(5, 0)}))
    want = {(i % 4, f"k{i}"): 2 if i < 3 else 1 for i in range(200) if i not in (3, 4)}
    assert state(log.snapshot()) == want and state(first) == {k: 1 for k in {**want, (3, "k3"): 1, (0, "k4"): 1}}
    with pytest.raises(Conflict):
        first.commit(Change(gone={"t": rows(200, 0)}))
    assert state(log.snapshot()) == want
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan(log.read("t").where("part = 3")))
    assert log.compact() == 2 and log.snapshot().changes("t") == 0 and state(log.snapshot()) == want
    assert log.compact(1) is None
    gone = log.vacuum()
    assert len(gone) >= 2 and state(log.snapshot()) == want
    # A small change of a large table writes little.
    log.snapshot().commit(Change(put={"u": spark.range(50000).select(F.uuid().alias("key"), F.col("id").cast("int").alias("v"))}))
    before = size(log.path)
    log.snapshot().commit(Change(put={"u": spark.createDataFrame([("x", 1)], "key string, v int")}))
    assert log.read("u").count() == 50001 and size(log.path) - before < before / 50


def test_null_keys_and_empty_changes(spark, tmp_path):
    log = TableLog(spark, str(tmp_path / "l"), {"u": Kept("key STRING, v INT", ("key",))})
    row = lambda *r: spark.createDataFrame(list(r), "key string, v int")
    log.snapshot().commit(Change(whole={"u": row((None, 1), ("a", 1))}))
    log.snapshot().commit(Change(put={"u": row((None, 2))}))
    log.snapshot().commit(Change(gone={"u": row()}))
    assert {(r.key, r.v) for r in log.read("u").collect()} == {(None, 2), ("a", 1)}


def test_lsh_index_of_two_inserts_equals_one_batch(spark, tmp_path):
    signed = clones.signatures(frame(spark, TEXTS), "key", "text").cache()
    want = {(r.doc_a, r.doc_b): r.similarity for r in clones.lsh_pairs(signed).collect()}
    index = LshIndex(spark, str(tmp_path / "lsh"))
    index.insert(signed.where("key < 'd'"))
    index.insert(signed.where("key >= 'c'"))
    assert index.size() == 5  # the empty text has no shingles
    found = {(r.query, r.key): r.similarity for r in index.search(signed).collect()}
    assert want and found == {**want, **{(b, a): s for (a, b), s in want.items()}}
    out = index.search_text(TEXTS["a"], limit=1).collect()
    assert [(r.key, r.similarity) for r in out] == [("a", 1.0)]
    asked = clones.signatures(frame(spark, {"q": TEXTS["a"]}), "key", "text")
    assert {r.key for r in index.query(asked).collect()} >= {"a"}
    one = index.read("bands").where(F.col("part").isin([1, 2]))
    assert re.search(r"PartitionFilters: \[[^\]]*part[^\]]* IN \(1,2\)", plan(one))
    index.insert(clones.signatures(frame(spark, {"b": TEXTS["e"]}), "key", "text"))  # b has another text now
    index.remove(frame(spark, {"d": ""}))
    assert {(r.query, r.key) for r in index.search(signed.where("key IN ('a', 'c')")).collect()} == set()
    assert {r.key for r in index.search(signed.where("key = 'e'")).collect()} == {"b"}


def bm25(texts, query, k):
    words = {key: re.findall(r"[^\W_]+", t.lower()) for key, t in texts.items()}
    mean, out = sum(map(len, words.values())) / len(words), {}
    for term in set(re.findall(r"[^\W_]+", query.lower())):
        held = [key for key, w in words.items() if term in w]
        for key in held:
            tf, n = words[key].count(term), len(words[key])
            out[key] = out.get(key, 0) + math.log(1 + (len(words) - len(held) + 0.5) / (len(held) + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))
    return sorted(((key, math.floor(s * 10**DIGITS + 0.5) / 10**DIGITS) for key, s in out.items()), key=lambda r: (-r[1], r[0]))[:k]


def test_text_index_equals_plain_scores_while_documents_change(spark, tmp_path):
    index, texts = TextIndex(spark, str(tmp_path / "text")), dict(TEXTS)
    got = lambda q, k=20, **o: [(r.key, r.score) for r in index.search(q, k, **o).orderBy("rank").collect()]
    assert got("fox") == []
    index.put(frame(spark, texts))
    assert got("The fox, the BOX") == bm25(texts, "the fox box", 20)
    assert got("the", 2) == bm25(texts, "the", 2) and got("unheard") == []
    assert [k for k, _ in got("box home", every=True)] == ["c"] and got("fox unheard", every=True) == []
    texts |= {"a": "box box box", "g": "a fox at home"}
    index.put(frame(spark, {k: texts[k] for k in "ag"}))
    index.remove(frame(spark, {"d": "", "none": ""}))
    del texts["d"]
    assert got("fox box") == bm25(texts, "fox box", 20)
    s = index.snapshot()
    assert {r.term for r in index.postings(s, ["fox", "box"]).collect()} == {"fox", "box"}
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan(index.postings(s, ["fox"]))) and "PushedFilters: [" in plan(index.postings(s, ["fox"]))


def test_postings_are_made_by_range_and_not_shuffled_word_by_word(spark, tmp_path, monkeypatch):
    from lodestone.operators import search

    monkeypatch.setattr(search, "RANGE", 2)
    made = list(search._ranges(iter(pa.record_batch({"key": [k], "terms": pa.array([t], pa.list_(pa.string())), "task": [3]}) for k, t in (("b", ["x", "y", "x"]), ("a", ["x"]), ("c", [])))))
    rows = [[(r["term"], r["range"], r["keys"], r["counts"], r["lengths"]) for r in m.to_pylist()] for m in made]
    first, second = 3 << 16, (3 << 16) + 1
    assert sorted(rows[0], key=str) == sorted([("x", first, ["a", "b"], [1, 2], [1, 3]), ("y", first, ["b"], [1], [3]), (None, first, ["a", "b"], [0, 0], [1, 3])], key=str)
    assert rows[1] == [(None, second, ["c"], [0], [0])]
