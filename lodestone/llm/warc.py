"""Operator 8: WARC archives, written with segmented records and reassembled on reading.

Writing: of pages with equal payloads the one with the smallest id becomes a ``response`` record,
the others ``revisit`` records that refer to it.  A response holds an HTTP message whose body is in
chunked transfer coding; one longer than ``segment`` bytes is split into a first record with
``WARC-Segment-Number: 1`` and ``continuation`` records, which name the first as their origin.
Archives are gzipped WARC/1.1 files of a bounded size, written by Spark's text writer, so they land in
whatever store the path names.

Reading: files are parsed by the records' lengths, as they are unzipped, so that a task holds one record
and not an archive.  Continuations are grouped by their origin, ordered by segment number, held against
the numbers 1..n and the total length that the last one states, joined, and the chunked body is decoded.
Revisits take length and digest from the response that they refer to.  No record is ever looked for in a
payload's text, so payloads may hold anything.

Rows are numbered in a written table, so that names are the same whenever they are read.  Only digests and
names are grouped, and pre-aggregated; what copies of one payload take from their group is sent to them,
or, where groups are too many for that, joined on the digest and a salt, so that no payload's copies are
one task's, however many pages share it.

Defined cases: a null payload counts as empty; a null id is kept and counts as larger than any
other; of rows with the same payload and id the first read is the response; an empty table gives an
empty archive; line breaks in a url are percent-encoded; a null url has no target field;
payloads below ``least`` bytes are never revisits; other input columns are not read; a record that can't be
read - cut short, of another digest than it states, or no text though asked for as text - raises, and names
the record, as does a revisit without its response: a reader that goes on would pass for a whole one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import picked, scratch, table, tidied, written

SEGMENT, CHUNK, LEAST = 16384, 4096, 0
#: Bytes of payload that one archive file takes, about; it bounds what a reading task holds.
FILE_BYTES = 8 << 20
#: Parts that the copies of one payload, or the revisits of one response, are joined in.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"


def uri(record: str) -> str:
    return f"<urn:record:{record}>"


def chunked(body: bytes, size: int) -> bytes:
    """The body in chunked transfer coding, cut between characters so that every chunk is text."""
    out, at = [], 0
    while at < len(body):
        end = cut(body, at, size)
        out += [b"%x\r\n" % (end - at), body[at:end], b"\r\n"]
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def cut(data: bytes, at: int, size: int) -> int:
    """The end of a part of about size bytes from at on that doesn't split a UTF-8 character."""
    end = min(len(data), at + max(size, 4))
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return end


def dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = data.index(b"\r\n", at)
        n = int(data[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        part = data[line + 2 : line + 2 + n]
        if len(part) < n or data[line + 2 + n : line + 4 + n] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(part)
        at = line + 4 + n


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def records(record: str, url: str, payload: bytes, digest: str, refers: str | None, segment: int, chunk: int) -> bytes:
    """All records of one page."""
    common = [("WARC-Record-ID", uri(record)), ("WARC-Date", DATE), ("WARC-Target-URI", url or None), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers is not None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", profile), ("WARC-Refers-To", uri(refers)), ("Content-Type", "application/http; msgtype=response")], http)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(http) <= segment:
        return _record([("WARC-Type", "response"), *common, kind], http)
    parts, at = [], 0
    while at < len(http):
        end = cut(http, at, segment)
        parts.append(http[at:end])
        at = end
    out = [_record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1), kind], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        last = ("WARC-Segment-Total-Length", len(http) if i == len(parts) else None)
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", uri(f"{record}:{i}")), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", uri(record)), ("WARC-Segment-Number", i), last], part))
    return b"".join(out)


def parsed(archive):
    """(header fields, block) of each record of an archive, which is bytes or a binary stream."""
    import io

    stream = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    at = 0
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        size, head = len(first), {}
        while (line := stream.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError(f"the record at byte {at} ends early")
            size += len(line)
            name, _, value = line[:-2].decode().partition(": ")
            head[name.lower()] = value
        n = int(head["content-length"])
        block, after = stream.read(n), stream.read(4)
        if len(block) < n or after != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} ends early")
        yield head, block
        at += size + n + 6


def _bare(value: str | None) -> str | None:
    return value.removeprefix("<urn:record:").removesuffix(">") if value else None


def _digest(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_roles(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """record, url, payload, refers: the record of the response to refer to, or null for responses.

    A record is named by the id and the row's number.  The rows are numbered in a table of digests, which
    is read again for the payloads: the table has all that the records are made from.
    """
    own = picked(pages, id=pages[key].cast("long"), url=url, payload=F.coalesce(pages[payload], F.lit("")))
    own = written(own.withColumns({"row": F.monotonically_increasing_id(), "sha": F.sha1(F.col("payload").cast("binary"))}))
    name = lambda i, r: F.concat_ws(".", F.coalesce(i.cast("string"), F.lit("")), r.cast("string"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    sized = own.select("id", "row", "sha", F.octet_length("payload").alias("bytes"))
    equal = sized.groupBy("sha", "bytes").agg(first, F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("bytes") >= least))
    # A table of its own, so that its size is known: a small one is sent to the rows.
    equal = written(equal.select("sha", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "first"))
    found = own.withColumn("salt", (F.col("row") % SALTS).cast("int")).join(equal, ["sha", "salt"], "left")
    refers = F.when(F.col("first.row") != F.col("row"), name(F.col("first.id"), F.col("first.row")))
    return found.select(name(F.col("id"), F.col("row")).alias("record"), "url", "payload", refers.alias("refers"))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", segment: int = SEGMENT, chunk: int = CHUNK, least: int = LEAST) -> None:
    """Writes the pages' records below path, in files of about FILE_BYTES."""

    def write(batches):
        held, size = [], 0
        for batch in batches:
            for record, at, text, refers in zip(batch["record"], batch["url"], batch["payload"], batch["refers"]):
                body = text.encode()
                one = records(record, "" if at is None else at.replace("\r", "%0D").replace("\n", "%0A"), body, _digest(body), refers, segment, chunk)
                held.append(one)
                size += len(one)
                if size >= FILE_BYTES // 8:
                    yield pd.DataFrame({"value": [b"".join(held)[:-2].decode()]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"value": [b"".join(held)[:-2].decode()]})

    rows = with_roles(pages, key, url, payload, least).mapInPandas(tidied(write), "value string")
    rows.write.option("lineSep", "\r\n").option("maxRecordsPerFile", 8).option("compression", "gzip").text(path)


_COLUMNS = ("record", "record_type", "refers", "payload_bytes", "payload_digest", "payload")
_SCHEMA = "record string, record_type string, refers string, payload_bytes long, payload_digest string, payload string"


def _decoded(record: str, http: bytes, stated: str | None, with_payload: bool) -> tuple:
    head, _, body = http.partition(b"\r\n\r\n")
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    digest = _digest(payload)
    if stated is not None and stated != f"sha1:{digest}":
        raise ValueError(f"the payload of {record} doesn't match its digest")
    try:
        return record, "response", None, len(payload), digest, payload.decode() if with_payload else None
    except UnicodeDecodeError as e:
        raise ValueError(f"the payload of {record} is no UTF-8 text") from e


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """record, record_type, refers, payload_bytes, payload_digest and, if asked for, payload; for
    revisits these are the response's."""

    def parse(batches):
        import gzip
        import io

        def row(head, block):
            record, kind = _bare(head["warc-record-id"]), head["warc-type"]
            number = head.get("warc-segment-number")
            if kind == "revisit":
                return (record, kind, _bare(head["warc-refers-to"]), *[None] * 7)
            if kind == "response" and number is None:
                return (*_decoded(record, block, head.get("warc-payload-digest"), with_payload), *[None] * 4)
            if kind in ("response", "continuation"):
                origin = record if kind == "response" else _bare(head["warc-segment-origin-id"])
                total = head.get("warc-segment-total-length")
                return (origin, *[None] * 5, int(number), total and int(total), head.get("warc-payload-digest"), block)
            return None  # records of other types hold no page

        def out(rows):
            made = pd.DataFrame(rows, columns=[*_COLUMNS, "number", "total", "stated", "block"])
            for c in ("payload_bytes", "number", "total"):
                made[c] = made[c].astype("Int64")
            return made

        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                with gzip.open(io.BytesIO(content)) as stream:
                    for head, block in parsed(stream):
                        if (r := row(head, block)) is not None:
                            rows.append(r)
                            size += len(block)
                        if size >= FILE_BYTES // 8:
                            yield out(rows)
                            rows, size = [], 0
                yield out(rows)

    def join(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.record_type is not None:
                    rows.append((r.record, r.record_type, r.refers, r.payload_bytes, r.payload_digest, r.payload))
                    continue
                parts = list(r.parts)
                http = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(http):
                    raise ValueError(f"segments of {r.record} are missing or too short")
                rows.append(_decoded(r.record, http, parts[0]["stated"], with_payload))
            out = pd.DataFrame(rows, columns=list(_COLUMNS))
            out["payload_bytes"] = out["payload_bytes"].astype("Int64")
            yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    rows = files.mapInPandas(tidied(parse), f"{_SCHEMA}, number int, total long, stated string, block binary")
    part = F.when(F.col("number").isNotNull(), F.struct("number", "total", "stated", "block"))
    whole = rows.groupBy("record").agg(*[F.max(c).alias(c) for c in _COLUMNS[1:]], F.sort_array(F.collect_list(part)).alias("parts"))
    whole = written(whole.mapInPandas(tidied(join), _SCHEMA))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    named = whole.where("record_type = 'revisit'").select("record", "record_type", "refers", F.pmod(F.xxhash64("record"), F.lit(SALTS)).cast("int").alias("salt"))
    wanted = named.select(F.col("refers").alias("record")).distinct()
    response = whole.where("record_type = 'response'").join(wanted, "record", "left_semi")
    response = response.select(F.col("record").alias("refers"), *_COLUMNS[3:], salts)
    revisit = named.join(response, ["refers", "salt"], "left")
    # Every response has a length.
    told = F.coalesce("payload_bytes", F.raise_error(F.concat(F.lit("a revisit refers to a missing response: "), "record")).cast("long"))
    return whole.where("record_type = 'response'").unionByName(revisit.withColumn("payload_bytes", told).select(*_COLUMNS))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    write_archive(table(spark, sf_dir, "pages"), path := scratch(spark))
    back = read_archive(spark, path, with_payload=False)
    page = lambda c: F.expr(f"try_cast(nullif(split_part({c}, '.', 1), '') AS BIGINT)")
    return back.select(page("record").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers").alias("refers_to"))


QUERIES = {"op8_warc": op8_warc}
ORACLES: dict = {}
