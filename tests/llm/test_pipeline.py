import re

import corpus_pipeline as c
import numpy as np
from lodestone.llm import packing, pii, toxicity
from tests.llm.test_overlap import plain
from tests.llm.test_toxicity import corpus


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rows, labels = corpus(400)
    rows += [(1000 + i, rows[1][1]) for i in range(20)] + [(2000, "write to a@b.example.com " + rows[2][1]), (2001, ""), (2002, None), (2003, " ".join(f"t{i}" for i in range(3000)))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    out = c.run(spark, str(tmp_path)).collect()

    rated = {r.doc_id: r.score for r in toxicity.toxicity(docs, known).collect()}
    left = [(k, t) for k, t in rows if rated[k] < toxicity.THRESHOLD]
    assert len(left) < len(rows)
    one = [(k, t) for k, t in left if dict((a, m) for a, _, m in plain(left))[k] == k]
    encode = packing.encoder()
    want = set()
    for k, t in one:
        for kind, a, b in reversed(pii.base_spans(t or "")):
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        n = len(encode(t or "")) + 1
        want |= {(k, i, s, m) for i, (s, m) in enumerate(packing.cuts(n, packing.CAPACITY))}
    assert {(r.doc_id, r.piece, r.start, r.length) for r in out} == want and len(out) == len(want)
    assert [n for n, _ in c.STAGES] == ["toxicity", "ngram_jaccard", "pii", "best_fit_packing"]


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.simpleString() == docs.schema.simpleString()
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert not any(re.search(packing.SPECIAL, r.text or "") for r in docs.collect())


def test_copies_of_clashing_rows(spark, sf):
    """Two texts under one id, repeated rows, and columns with names that are used inside."""
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, text, 0, "a"), (1, other, 0, "b"), (2, text + " end", 1, "c"), (3, other, 1, "d"), (1, text, 0, "a"), (None, text, 2, "e"), (None, text, 2, "e"), (4, None, 3, "f"), (5, "", 3, "g"), (4, None, 3, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, key string")
    out = c.without_copies(spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], rows[1], rows[5], rows[6], rows[7], rows[8]], key=str)
    rated = c.without_toxic(spark, docs.withColumn("Score_", docs["score"]), sf)
    assert rated.columns == [*docs.columns, "Score_"] and rated.count() == len(rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_ids_are_those_of_the_redacted_texts(spark, tmp_path):
    rows = [(1, "write to a@b.example.com or call"), (2, ""), (3, " ".join(f"t{i}" for i in range(3000)))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out, encode = c.run(spark, str(tmp_path)).collect(), packing.encoder()
    for k, t in rows:
        for kind, a, b in reversed(pii.base_spans(t)):
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        pieces = sorted((r.piece, r.length, np.frombuffer(r.ids, dtype="<u4").tolist()) for r in out if r.doc_id == k)
        assert [x for _, _, ids in pieces for x in ids] == [*encode(t), packing.END_ID]
        assert all(len(ids) == n for _, n, ids in pieces)


def test_repeated_rows_are_dropped_before_rows_move(spark, sf):
    """Each task leaves one row of each id and text before the exchange, whatever share repeats it."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text)] * 2000 + [(i, f"{text} {i} x y") for i in range(2, 4)], "doc_id long, text string")
    out = c.without_copies(spark, docs, sf)
    assert [r.doc_id for r in out.collect()] == [1]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "first(row" in line]
    assert whole and "Join LeftSemi" in plan and plan.index("Join LeftSemi") < plan.index("first(row")
