import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import warc as w
from lodestone.llm.common import scratch


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200), st.integers(1, 20), st.integers(4, 60))
def test_records_round_trip(text, chunk, segment):
    body = text.encode()
    assert w.dechunked(w.chunked(body, chunk)) == body
    made = w.records("1.0", "u", body, digest(text), None, segment, chunk)
    made.decode()
    found = list(w.parsed(made))
    http = b"".join(block for _, block in found)
    assert w.dechunked(http.partition(b"\r\n\r\n")[2]) == body
    assert [h.get("warc-segment-number") for h, _ in found] == ([None] if len(found) == 1 else [str(i + 1) for i in range(len(found))])


def test_damaged_archives_are_told():
    made = w.records("1.0", "u", b"x" * 50, digest("x" * 50), None, 1000, 10)
    for bad in (made[:-10], b"no record" + made, made.replace(b"\r\n0\r\n", b"\r\n")):
        with pytest.raises(ValueError):
            list(w.parsed(bad))


PAGES = [
    (1, "http://a/1", "x" * 50_000 + "é" * 30_000),
    (2, None, None),
    (3, "http://a\nb", ""),
    (5, "u", "WARC/1.1\r\n\r\n0\r\n\r\n"),
    (4, "u", "WARC/1.1\r\n\r\n0\r\n\r\n"),
    (None, "u", "é"),
    (6, "u", "é"),
    (6, "u", "é"),
    (7, "u", "\r\n"),
    (8, "u", "x" * 50_000 + "é" * 30_000),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "extra") for r in PAGES], "page_id long, url string, html string, record string")
    w.write_archive(pages, path := scratch(spark), segment=1000, chunk=100)
    out = w.read_archive(spark, path).collect()
    page = lambda r: None if r is None or r.startswith(".") else int(r.split(".")[0])
    got = sorted((page(r.record), r.payload, r.payload_bytes, r.payload_digest) for r in out if page(r.record) is not None)
    want = sorted((k, t or "", len((t or "").encode()), digest(t)) for k, _, t in PAGES if k is not None)
    assert got == want and len(out) == len(PAGES)
    kinds = {}
    for r in out:
        kinds.setdefault(page(r.record), []).append((r.record_type, page(r.refers)))
    assert kinds[1] == [("response", None)] and kinds[8] == [("revisit", 1)]
    assert kinds[2] == [("response", None)] and kinds[3] == [("revisit", 2)]
    assert kinds[4] == [("response", None)] and kinds[5] == [("revisit", 4)]
    assert sorted(kinds[6], key=str) == [("response", None), ("revisit", 6)] and kinds[None] == [("revisit", 6)]


def test_small_payloads_may_be_kept(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    w.write_archive(pages, path := scratch(spark), least=3)
    kinds = {r.record.split(".")[0]: r.record_type for r in w.read_archive(spark, path).collect()}
    assert kinds == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_missing_segment(spark, tmp_path):
    import gzip

    made = w.records("1.0", "u", b"x" * 500, digest("x" * 500), None, 100, 50)
    heads = list(w.parsed(made))
    at = made.index(b"WARC/1.1", 10)
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(made[:at] + made[made.index(b"WARC/1.1", at + 10) :]))
    assert len(heads) > 3
    with pytest.raises(Exception, match="missing"):
        w.read_archive(spark, str(tmp_path)).collect()


def test_dangling_and_unreadable_records_are_told(spark, tmp_path):
    import gzip

    revisit = w.records("2.1", "u", b"abc", digest("abc"), "1.0", 1000, 50)
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(revisit))
    with pytest.raises(Exception, match="missing response"):
        w.read_archive(spark, str(tmp_path)).collect()
    made = w.records("1.0", "u", b"\xff\xfe", base64.b32encode(hashlib.sha1(b"\xff\xfe").digest()).decode(), None, 1000, 50)
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(made))
    with pytest.raises(Exception, match="UTF-8"):
        w.read_archive(spark, str(tmp_path)).collect()
    assert [r.payload_bytes for r in w.read_archive(spark, str(tmp_path), with_payload=False).collect()] == [2]


def test_many_copies_of_one_payload(spark):
    """Rows whose order is not fixed: a third have one payload, and every revisit finds its response."""
    rows = [(i, "u", "the same" if i % 3 else f"own {i}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7, "html", "page_id").orderBy("url").repartition(5)
    w.write_archive(pages, path := scratch(spark))
    out = w.read_archive(spark, path).collect()
    assert len(out) == 600 and {r.payload for r in out} == {h for _, _, h in rows}
    kinds = {int(r.record.split(".")[0]): r for r in out}
    assert all(r.record_type == ("revisit" if k % 3 and k > 1 else "response") for k, r in kinds.items())
    assert {r.refers.split(".")[0] for r in out if r.refers} == {"1"}


def test_archives_are_read_record_by_record():
    import io

    made = b"".join(w.records(f"{i}.0", "u", bytes([65 + i]) * 99, digest(chr(65 + i) * 99), None, 1000, 40) for i in range(3))
    assert [h["warc-record-id"] for h, _ in w.parsed(io.BytesIO(made))] == [h["warc-record-id"] for h, _ in w.parsed(made)]
    assert [b for _, b in w.parsed(io.BytesIO(made))] == [b for _, b in w.parsed(made)]


def test_empty(spark):
    w.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path := scratch(spark))
    assert w.read_archive(spark, path).count() == 0
