import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import urls as u


def test_rules_and_parts(spark):
    rows = [
        (1, None, "", "", None),
        (2, "nope", "", "", None),
        (3, "HTTP://Ex.COM", "ex.com", "", None),
        (4, "x://É.COM/é\n?a#b", "É.com", "/é\n", "com/"),
        (5, "://a.b/c://d", "a.b", "/c://d", None),
        (6, "http://www.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/"),
        (7, "http://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/"),
        (8, "http://blog.example.com/en/#t", "blog.example.com", "/en/", "example.com/en/"),
        (9, "http://blog.example.com/EN/", "blog.example.com", "/EN/", "com/"),
        (10, "http://notexample.net/es/1", "notexample.net", "/es/1", "net/es/"),
        (11, "http://telecom/", "telecom", "/", None),
        (12, "http://com/", "com", "/", "com/"),
        (12, "http://com/", "com", "/", "com/"),
        (None, "http://x.net/fr/?q", "x.net", "/fr/", "net/fr/"),
    ]
    df = spark.createDataFrame([(r[0], r[1], "c") for r in rows], "page_id long, url string, host string")
    out = u.judge(df).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted([(r.page_id, r.host, r.path, r.rule) for r in out], key=key) == sorted([(a, *b) for a, _, *b in rows], key=key)
    wanted = {"com/": "allow", "www.example.com/en/": "allow", "example.com/en/": "block", "net/es/": "block", "net/fr/": "block"}
    assert all(r.verdict == wanted[r.rule] for r in out if r.rule)


def test_model_tells_kinds_apart(spark):
    rows = [(i, f"http://{chr(97 + i % 26)}{chr(97 + i // 26)}.good.com/read/news/{i}") for i in range(300)]
    rows += [(1000 + i, f"http://{chr(97 + i % 26)}{chr(97 + i // 26)}.bad.net/es/xxqq/zz{i}") for i in range(300)]
    rows += [(5000, "http://z.good.org/read/news/7"), (5001, "http://z.bad.org/xxqq/zz7")]
    out = {r.page_id: r for r in u.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (out[5000].verdict, out[5001].verdict) == ("allow", "block")


def test_model_reads_the_query_and_all_characters(spark):
    host = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26)}"
    rows = [(i, f"http://{host(i)}.good.com/p?sort=%C3%A9~Ж{i}") for i in range(300)]
    rows += [(1000 + i, f"http://{host(i)}.good.net/es/?buy=%F0;Щ{i}") for i in range(300)]
    rows += [(5000, "http://z.good.org/p?sort=%C3%A9~Ж7"), (5001, "http://z.good.org/p?buy=%F0;Щ7")]
    out = {r.page_id: r for r in u.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (out[5000].verdict, out[5001].verdict) == ("allow", "block")


def test_models_equal_a_plain_version(spark):
    import math
    from collections import Counter

    rows = [(i, f"http://{'abcdefgh'[i % 8]}{i % 5}.x.{'com' if i % 3 else 'net'}/{'es/' if i % 2 else ''}é😀{i * i}") for i in range(90)] + [(999, None)]
    out = {r.page_id: r for r in u.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    texts = {k: u.START + (t or "").lower() + u.END for k, t in rows}
    kinds = {c: [k for k, r in out.items() if r.rule and r.verdict == c and r.score is None] for c in ("allow", "block")}
    assert all(len(k) > 5 for k in kinds.values())
    scored = [k for k, r in out.items() if r.score is not None]
    signs = {c for k in [*kinds["allow"], *kinds["block"], *scored] for c in texts[k][1:]}

    def log_likelihood(kind, text):
        gram, context = Counter(), Counter()
        for k in kinds[kind]:
            for i in range(1, len(texts[k])):
                for n in range(min(i + 1, u.ORDER)):
                    gram[texts[k][i - n : i + 1]] += 1
                    context[n, texts[k][i - n : i]] += 1
        total = 0.0
        for i in range(1, len(text)):
            p = (gram[text[i]] + 1) / (context[0, ""] + len(signs))
            for n in range(1, min(i + 1, u.ORDER)):
                p = (gram[text[i - n : i + 1]] + u.BACKOFF * p) / (context[n, text[i - n : i]] + u.BACKOFF)
            total += math.log(p)
        return total

    for k in [*scored[:10], 999]:
        want = (log_likelihood("allow", texts[k]) - log_likelihood("block", texts[k])) / (len(texts[k]) - 1)
        assert abs(out[k].score - want) < 1e-9


def test_long_urls_take_linear_time(spark):
    import time

    took = []
    for n in (100_000, 400_000):
        rows = [(1, "http://a.org/" + "xy/Ж%" * (n // 5)), (2, "http://a.com/"), (3, "http://b.net/es/")]
        df = spark.createDataFrame(rows, "page_id long, url string")
        began = time.time()
        assert u.judge(df).count() == 3
        took.append(time.time() - began)
    assert took[1] < 2.5 * took[0] + 5


def test_models_grow_with_the_data(spark):
    rows = lambda n: [(i, f"http://h{i}.{'com' if i % 2 else 'net'}/{'' if i % 2 else 'es/'}{i * 7919 % 10007:x}") for i in range(n)]
    sizes = []
    for n in (50, 500):
        df = spark.createDataFrame(rows(n), "row long, url string")
        own = df.select("row", F.lit("allow").alias("ruled"), F.lit(False).alias("unseen"), F.split(F.concat(F.lit(u.START), "url", F.lit(u.END)), "").alias("chars"))
        sizes.append(u.model(u.windows(own)).count())
    assert sizes[1] > 5 * sizes[0]


def test_oracle(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(map(str, duckdb.sql(u._oracle()).fetchall()))
    assert sorted(str(tuple(r)) for r in u.op4_url_filter(spark, sf).collect()) == want


def test_plan_is_native(spark, sf):
    plan = u.op4_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_nothing_that_grows_is_broadcast(spark, sf, monkeypatch):
    """Neither in the result's plan, nor in those of the tables on the way, and also if Spark finds a side small."""
    plans, real = [], u.written

    def plan(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(u, "written", lambda df: plan(df) or real(df))
    monkeypatch.setattr(u, "threshold", lambda df, f=u.threshold: plan(df) or f(df))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    plan(u.op4_url_filter(spark, sf))
    assert sum("SortMergeJoin" in p for p in plans) == u.ORDER + 2
    assert not any("Broadcast" in p for p in plans)


def test_empty(spark):
    assert u.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    with pytest.raises(Exception, match="url"):
        u.judge(spark.createDataFrame([], "page_id long"))
