import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lines as d

SPACE = " \t\n\r\x0b\x0c"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts, least, first=False, shortest=1):
    """(n_lines, n_dropped, kept text) of each text, by one loop over all lines."""
    split = [(t or "").split("\n") for t in texts]
    key = lambda line: line.strip(SPACE).translate(LOWER)
    held, met = defaultdict(set), set()
    for i, own in enumerate(split):
        for line in own:
            held[key(line)].add(i)
    out = []
    for own in split:
        kept = []
        for line in own:
            k = key(line)
            hot = len(k) >= shortest and len(held[k]) >= least
            if not hot or (first and k not in met):
                kept.append(line)
            met.add(k)
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def corpus(n, seed=3):
    rng = random.Random(seed)
    pool = ["all rights reserved", " All Rights RESERVED\t", "", "  ", "é", "É", "x", "line " * 40, "a\x00b"]
    rare = [f"line {i}" for i in range(40)]
    out = [None, "", "\n", "x\nx\nX \nx", "no newline"]
    while len(out) < n:
        out.append("\n".join(rng.choice(pool if rng.random() < 0.4 else rare) for _ in range(rng.randint(1, 9))))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, keep int").coalesce(1)


def got(df, text="text"):
    return [(r.n_lines, r.n_dropped, r[text]) for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("least", [1, 2, 10])
@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("shortest", [1, 3])
def test_kept_texts_equal_a_plain_version(spark, least, first, shortest):
    texts = corpus(120)
    out = d.without_repeated_lines(frame(spark, texts), least=least, first=first, shortest=shortest)
    assert got(out) == plain(texts, least, first, shortest)


def test_every_place_of_a_partitions_bounds_gives_the_same_lines():
    """Sorted rows cut anywhere into partitions and batches: what the edges leave open is settled by counts."""
    rng = random.Random(5)
    rows = sorted((rng.choice([1, 1, 1, 2, 3, 4, 5]), 0, number, bytes([p, 0, 0, 0])) for number in range(40) for p in (0, 1))
    rows = [r for i, r in enumerate(rows) if not i or r[:3] != rows[i - 1][:3]]
    for least in (1, 3, 10):
        for first in (False, True):
            want = None
            for _ in range(30):
                cuts = sorted(rng.sample(range(1, len(rows)), rng.randint(0, 5)))
                found, open_, edges = [], [], defaultdict(list)
                for a, b in zip([0, *cuts], [*cuts, len(rows)]):
                    inner = sorted(rng.sample(range(a + 1, b), min(b - a - 1, 3)))
                    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[x:y]]) for i in range(4)], schema=d._KEYS) for x, y in zip([a, *inner], [*inner, b])]
                    said = [r for out in d.streamed(iter(batches), least, first) for r in out.to_pylist()]
                    assert sum(r["kind"] == d._EDGE for r in said) <= 2
                    assert sum(r["kind"] == d._OPEN for r in said) <= 2 * least
                    found += [(r["number"], r["at"]) for r in said if r["kind"] == d._DROP]
                    open_ += [r for r in said if r["kind"] == d._OPEN]
                    for r in said:
                        if r["kind"] == d._EDGE:
                            edges[r["hi"]].append((r["n"], r["number"]))
                for r in open_:
                    if sum(n for n, _ in edges[r["hi"]]) >= least:
                        head = first and r["number"] == min(s for _, s in edges[r["hi"]])
                        found += [(r["number"], r["at"][4:] if head else r["at"])]
                found = sorted(x for x in found if x[1])
                assert want is None or found == want
                want = found


def test_bitmaps_say_which_lines_stay(spark):
    texts = ["a\nb\nc", "b", None]
    out = d.line_bitmaps(frame(spark, texts), least=2)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "keep"]  # keep of the input gives way
    rows = {r.doc_id: r for r in out.collect()}
    assert [d.kept_text(t or "", bytes(rows[i].keep)) for i, t in enumerate(texts)] == ["a\nc", "", ""]


def test_a_key_of_a_third_of_all_rows_is_dealt(spark):
    """The largest partition of the sort has few more rows than the median one."""
    texts = ["hot" if i % 3 == 0 else f"line {i}" for i in range(3000)]
    rows = d.numbered(frame(spark, texts))
    dealt = d.hashed_keys(rows).repartitionByRange(16, "hi", "lo", "number")
    sizes = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] < 4 * sizes[len(sizes) // 2]
    assert got(d.without_repeated_lines(frame(spark, texts))) == plain(texts, 10)


def test_repeated_rows_null_ids_clashing_names_and_long_texts(spark):
    long = "\n".join(f"l{i % 7}" for i in range(200_000))
    rows = [(1, "dup", 1, "n")] * 9 + [(None, "dup", 2, "n"), (None, None, 3, "n"), (5, long, 4, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, number int, N_Lines string")
    out = d.without_repeated_lines(df)
    assert out.columns == ["doc_id", "number", "text", "n_lines", "n_dropped"]
    found = sorted((r.doc_id or 0, r.number, r.n_lines, r.n_dropped, r.text) for r in out.collect())
    assert found == sorted([(1, 1, 1, 1, "")] * 9 + [(0, 2, 1, 1, ""), (0, 3, 1, 0, ""), (5, 4, 200_000, 0, long)])
    assert d.without_repeated_lines(df.limit(0)).count() == 0


def test_query_gives_hashes_of_kept_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = [(r.doc_id, n, m, hashlib.sha256(t.encode()).hexdigest()) for r, (n, m, t) in zip(docs, plain([r.text for r in docs], 10))]
    assert sorted(tuple(r) for r in d.op11_line_dedup(spark, sf).collect()) == want
