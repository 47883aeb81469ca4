from collections import Counter

import pytest

from lodestone.llm import sharding as s


def plain(shards, slots):
    """The table by whole permutations, as defined."""
    perms = []
    for name in shards:
        offset, skip = s._hash(f"offset:{name}") % slots, s._hash(f"skip:{name}") % (slots - 1) + 1
        perms.append([(offset + j * skip) % slots for j in range(slots)])
    owner, turn = {}, 0
    while len(owner) < slots:
        i = turn % len(shards)
        owner[next(p for p in perms[i] if p not in owner)] = i
        turn += 1
    return [owner[j] for j in range(slots)]


@pytest.mark.parametrize(("n", "slots"), [(1, 7), (3, 101), (10, 499)])
def test_table_is_filled_by_turns(n, slots):
    names = tuple(f"s{i}" for i in range(n))
    table = s.fill(names, slots)
    assert table == plain(names, slots)
    sizes = Counter(table).values()
    assert max(sizes) - min(sizes) <= 1


def test_few_slots_move_when_a_shard_leaves():
    names = tuple(f"s{i}" for i in range(20))
    before, after = s.fill(names, 4999), s.fill(names[:-1], 4999)
    moved = sum(a != b for a, b in zip(before, after) if a != 19)
    assert moved < 0.1 * 4999


def test_bad_tables():
    for names, slots in (((), 7), (("a", "a"), 7), (("a",), 9), (("a", "b", "c"), 2)):
        with pytest.raises(ValueError):
            s.fill(names, slots)


def test_rows(spark):
    rows = [(1, "x"), (1, "x"), (None, "y"), (2, None)]
    df = spark.createDataFrame(rows, "id long, slot string").withColumnRenamed("slot", "shard_name")
    out = s.assign_shards(df, "id", ("a", "b", "c"), 101).collect()
    table = s.fill(("a", "b", "c"), 101)
    assert len(out) == 4
    import hashlib

    for r in out:
        slot = int(hashlib.md5(("" if r.id is None else str(r.id)).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard, r.shard_name) == (slot, table[slot], "abc"[table[slot]])
    assert s.assign_shards(df.limit(0), "id").count() == 0


def test_clashing_names_and_long_keys(spark, tmp_path):
    import hashlib

    rows = [("k" * 500_000, 3, "x", 7, "y"), (None, 4, "z", 8, "w"), ("", 5, "", 9, "v")]
    df = spark.createDataFrame(rows, "`a.b` string, __slot int, Slot string, row int, SHARD_NAME string")
    out = s.assign_shards(df, "a.b").collect()
    assert out[0].__fields__ == ["a.b", "__slot", "row", "slot", "shard", "shard_name"]
    for r in out:
        assert (r["a.b"], r["__slot"], r["row"]) in [(a, b, d) for a, b, _, d, _ in rows]
        assert r.slot == int(hashlib.md5((r["a.b"] or "").encode()).hexdigest()[:15], 16) % s.SLOTS
    s.write_shards(df, "a.b", str(tmp_path / "out"), splits=2)
    back = s.read_shards(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, out))


def test_plan_has_no_shuffle_and_no_python(spark, sf):
    plan = s.op1_sharding(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan and "Broadcast" in plan


def test_write(spark, tmp_path):
    df = spark.createDataFrame([(i, "t") for i in range(100)], "id long, t string")
    s.write_shards(df, "id", str(tmp_path / "out"), ("a", "b"), splits=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_whole_documents_are_written_and_read_back(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(s, "scratch", lambda spark: str(tmp_path / "shards"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id: (r.shard, r.shard_name) for r in s.op1_sharding(spark, sf).collect()}
    back = s.read_shards(spark, str(tmp_path / "shards"), docs.schema)
    assert back.columns == [*docs.columns, "slot", "shard", "shard_name"]
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert {r.doc_id: (r.shard, r.shard_name) for r in back.collect()} == out


def test_equal_rows_of_one_shard_are_several_tasks(spark, tmp_path):
    df = spark.createDataFrame([(1, "same", {"a": 1})] * 4000 + [(i, "own", {}) for i in range(8000)], "id long, turn string, m map<string,int>")
    spark.conf.set("spark.sql.shuffle.partitions", 512)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s.write_shards(df, "id", str(tmp_path / "out"), ("a", "b", "c"), splits=8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 12000 and "turn" in back.columns and "turn_" not in back.columns
    files = sorted(r["count"] for r in back.groupBy(s.F.input_file_name().alias("f")).count().collect())
    assert files[-1] < 4 * files[len(files) // 2]
