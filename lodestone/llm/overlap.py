"""Operator 5: n-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row for each distinct set of word shingles and a column for each shingle.  Links
need the product of the matrix with its transpose: the overlap counts.  It is never formed whole:

1. Shingle columns are dealt into blocks by their hash, the more of them the more text there is.  A
   block finds which of its columns are not empty but for one row; other columns can't add to any
   overlap.  Columns that a sample of the texts shows to be in very many rows meet in no block: they are
   shared for certain, and count as the most frequent ones.
2. A row is left out if fewer of its columns remain than the bound on its size demands: with
   n shingles and threshold t, any partner shares at least t*n of them.
3. Rows that a cheap minhash key puts next to each other are compared with a few leaders, whose
   product is counted exactly; a row linked to a leader is in its class.  Keys of over HOT rows are
   split by salt, and the leaders meet again under other keys.  So a group of near copies of any size takes work in
   proportion to it and gives one edge a row.
4. For whatever the keys missed, the exact bound: with columns ordered by how many rows they have,
   two linked rows share one of their first n - ceil(t*n) + 1 columns.  Rows with the same most
   frequent column lie together in blocks of about ROWS.  The columns of those beginnings tell which
   blocks of rows may hold linked ones of different classes and of sizes near enough; only pairs of
   blocks are listed, never pairs of rows, and those of a column in very many blocks chunk by chunk.
   Their product is accumulated column block by column block, and each gives a spanning tree of its
   links.

Classes are then the components of all edges found, by alternating stars.

Links are counted exactly on hashes: sets are named by 63 bits, columns compared by 48.

Result: n_shingles and component_id for each input row.  Defined cases: null and empty texts, and
those without words, have no shingles and link with nothing; repeated rows and equal sets form one
class; rows with a null id are kept, linked with nothing, and have a null component; an empty table
gives no rows; other columns are not read.  Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import partitions, picked, table, tidied, written
from lodestone.llm.components import components, roots

WORDS, PERCENT = 5, 80
LEADERS, ROUNDS, HOT = 6, 3, 128
#: Rows in a block, and columns that its product takes at a time.
ROWS, COLUMNS = 256, 4096
#: Bytes of text that are hashed at a time, and bytes of text for each block of columns.
PART, BLOCK_TEXT = 1 << 20, 64 << 20
#: Rows of the least sample that frequent columns are looked for in, its share of larger inputs, rows
#: that make a column frequent, and how many such columns are set apart.
SAMPLE, SAMPLE_SHARE, FREQUENT, FREQUENT_SHARE, APART = 2000, 1 / 65536, 1 << 20, 0.005, 65536
#: Bits of a row's number in a cell; a block of more rows is sorted in a slower way.
ROW_BITS = 24
#: Entries of a column that one task holds against each other.
CHUNK = 1024
#: Of a column's rows as they are counted; frequent columns count more than any other.
MOST = 65535

_M1, _M2, _R = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    r, inverse = _R, pow(_R, -1, 1 << 64)
    out = []
    for base in (r, inverse):
        p = np.ones(1, dtype=np.uint64)
        step = base
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(step)])
            step = step * step % (1 << 64)
        out.append(p[:n])
    return out[0], out[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ASCII-lower-cased data, and where they start."""
    raw = np.frombuffer(data, dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
    power, inverse = _powers(len(raw))
    total = np.concatenate([[np.uint64(0)], np.cumsum(codes[raw] * power, dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _shingled(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of so many words, or of all words if there are fewer."""
    n = len(words)
    take = min(width, n)
    out = np.full(n - take + 1, np.uint64(take), dtype=np.uint64)
    for i in range(take):
        out = mix(out + words[i : n - take + 1 + i] * np.uint64(2 * i + 1))
    return out


def shingle_sets(texts: list[bytes], width: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each UTF-8 text."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0

    def flush() -> None:
        hashes, starts = word_hashes(b" ".join(part))
        bounds = np.cumsum([0] + [len(p) + 1 for p in part])
        at = np.searchsorted(starts, bounds)
        for a, b in zip(at[:-1], at[1:]):
            out.append(np.unique(_shingled(hashes[a:b], width)) if b > a else np.zeros(0, dtype=np.uint64))

    for t in texts:
        data = t.lower()  # of bytes: A-Z alone
        if part and size + len(data) > PART:
            flush()
            part, size = [], 0
        part.append(data)
        size += len(data) + 1
    if part:
        flush()
    return out


def set_id(shingles: np.ndarray) -> int:
    """A hash of a set, not negative."""
    if not len(shingles):
        return 0
    total = np.bitwise_xor.reduce(mix(shingles + np.uint64(1)), keepdims=True) + mix(np.add.reduce(mix(shingles), keepdims=True)) + np.uint64(len(shingles))
    return int(mix(total)[0] >> np.uint64(1))


def least_common(n: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """The overlap that a set of n needs with any partner."""
    return -(-n * percent // 100)


def linked(common: int | np.ndarray, n: int | np.ndarray, m: int | np.ndarray, percent: int = PERCENT) -> bool | np.ndarray:
    return 100 * common >= percent * (n + m - common)


# Columns travel as 5 bytes of their hash, beside the block, which stands for more bits of it; once
# the blocks are done with, as 6 bytes of a hash of both.


def packed(tokens: np.ndarray, width: int) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


_ROWS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("set", pa.int64()), ("dest", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("degrees", pa.binary())])
_ROWS_DDL = "kind int, key long, n long, set long, dest int, block int, ids binary, sizes binary, counts binary, tokens binary, degrees binary"


def _batch(schema: pa.Schema, length: int, /, **columns) -> pa.RecordBatch:
    def made(f: pa.Field) -> pa.Array:
        given = columns.get(f.name)
        return pa.nulls(length, f.type) if given is None else given.cast(f.type) if isinstance(given, pa.Array) else pa.array(given, type=f.type)

    return pa.RecordBatch.from_arrays([made(f) for f in schema], schema=schema)


def _dealt(dest: np.ndarray, row: np.ndarray, tokens: np.ndarray, degrees: np.ndarray | None, ids: np.ndarray, sizes: np.ndarray, block: int | None, kind: int = 1) -> pa.RecordBatch:
    """One packed row for each destination.  row: of each token the index into ids and sizes, rising."""
    order = np.argsort(dest, kind="stable")
    sorted_dest = dest[order]
    bounds = np.flatnonzero(np.concatenate([[True], sorted_dest[1:] != sorted_dest[:-1], [True]]))
    out: dict[str, list] = {k: [] for k in ("dest", "ids", "sizes", "counts", "tokens", "degrees")}
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = order[a:b]
        r = row[own]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        which = r[first]
        out["dest"].append(int(sorted_dest[a]))
        out["ids"].append(ids[which].astype("<i8").tobytes())
        out["sizes"].append(sizes[which].astype("<u4").tobytes())
        out["counts"].append(np.diff(np.concatenate([first, [len(r)]])).astype("<u4").tobytes())
        out["tokens"].append(packed(tokens[own], 5))
        out["degrees"].append(None if degrees is None else degrees[own].astype("<u2").tobytes())
    n = len(out["dest"])
    return _batch(_ROWS, n, kind=[kind] * n, block=[block] * n, **out)


def frequent(docs: DataFrame, width: int, rows: int) -> np.ndarray:
    """The columns that a sample, by a hash of the texts' lengths and ids, finds in the most rows,
    sorted.  They only save work; what they are changes no result."""
    size = min(rows, max(SAMPLE, int(rows * SAMPLE_SHARE)))
    least = max(8, int(size * min(FREQUENT_SHARE, FREQUENT / (2 * max(1, rows)))))
    if size < least:
        return np.zeros(0, dtype=np.uint64)

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), width)
            columns, n = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(columns.view(np.int64)), pa.array(n)], names=["column", "n"])

    drawn = docs.where(F.pmod(F.xxhash64("key", F.length("text")), F.lit(1 << 30)) < int((1 << 30) * size / rows)).select("text")
    counts = drawn.mapInArrow(tidied(count), "column long, n long").groupBy("column").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "column").limit(APART).collect()
    return np.sort(np.array([r.column for r in found], dtype=np.int64).view(np.uint64))


def _incidence(docs: DataFrame, width: int, blocks: int, apart: np.ndarray) -> DataFrame:
    """Kind 0: key, n and set of each document; kind 1: packed rows of the matrix for one block; kind 2:
    frequent columns of rows, by their number among them, as a block of their own."""

    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text").cast(pa.binary()).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 2 * PART):
                    size += len(texts[end])
                    end += 1
                sets = shingle_sets(texts[at:end], width)
                ids = np.array([set_id(s) for s in sets], dtype=np.int64)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                own = keys.slice(at, end - at)
                spread = np.arange(at, end) % blocks
                yield _batch(_ROWS, end - at, kind=[0] * (end - at), key=own, n=sizes, set=ids, dest=spread)
                _, first = np.unique(ids, return_index=True)  # copies count once
                first = np.sort(first[sizes[first] > 0])
                if len(first):
                    tokens = np.concatenate([sets[i] for i in first])
                    row = np.repeat(np.arange(len(first)), sizes[first])
                    if len(apart):
                        number = np.minimum(np.searchsorted(apart, tokens), len(apart) - 1)
                        hot = apart[number] == tokens
                        if hot.any():
                            degrees = np.full(int(hot.sum()), MOST)
                            yield _dealt(ids[first][row[hot]] % blocks, row[hot], number[hot].astype(np.uint64), degrees, ids[first], sizes[first], blocks, 2)
                            tokens, row = tokens[~hot], row[~hot]
                    if len(tokens):  # all of a part's columns may be frequent ones
                        dest = ((tokens & np.uint64(0xFFFFFF)) % np.uint64(blocks)).astype(np.int64)
                        yield _dealt(dest, row, tokens >> np.uint64(24), None, ids[first], sizes[first], None)
                at = end

    return docs.mapInArrow(tidied(emit), _ROWS_DDL)


def _gathered(batches: Iterator[pa.RecordBatch], by: str, kinds: tuple[int, ...]):
    """Returns rows of these kinds by the value of a column, and passes others on."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        own = np.isin(batch.column("kind").to_numpy(zero_copy_only=False), kinds)
        if not own.all():
            yield batch.filter(pa.array(~own))
        rest = batch.filter(pa.array(own))
        for r in zip(*(rest.column(c).to_pylist() for c in (by, "block", "ids", "sizes", "counts", "tokens", "degrees"))):
            held.setdefault(r[0], []).append(r[1:])
    return held


def _joined(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, their sizes, each token's index into them, and the tokens."""
    ids = np.frombuffer(b"".join(r[1] for r in rows), dtype="<i8")
    sizes = np.frombuffer(b"".join(r[2] for r in rows), dtype="<u4")
    counts = np.frombuffer(b"".join(r[3] for r in rows), dtype="<u4")
    tokens = unpacked(b"".join(r[4] for r in rows), 5)
    which, first, back = np.unique(ids, return_index=True, return_inverse=True)
    return which, sizes[first], np.repeat(back.astype(np.int64), counts), tokens


def _counted(tokens: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """token, row, and how many rows have the token, of each cell of the columns that several rows have."""
    if rows < 1 << ROW_BITS:
        shift = np.uint64(ROW_BITS)
        cells = tokens << shift
        cells |= row.view(np.uint64)
        del tokens, row
        cells.sort()
        new = np.ones(len(cells), dtype=bool)
        np.not_equal(cells[1:], cells[:-1], out=new[1:])
        cells = cells[new]
        tokens, row = cells >> shift, (cells & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64)
        del cells, new
    else:
        order = np.lexsort((row, tokens))
        tokens, row = tokens[order], row[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
        tokens, row = tokens[new], row[new]
    start = np.ones(len(tokens) + 1, dtype=bool)
    np.not_equal(tokens[1:], tokens[:-1], out=start[1:-1])
    degree = np.diff(np.flatnonzero(start))
    shared = np.repeat(degree > 1, degree)
    return tokens[shared], row[shared], np.repeat(np.minimum(degree, MOST - 1)[degree > 1], degree[degree > 1])


def _shared(batches: Iterator[pa.RecordBatch], blocks: int):
    """Of each block the columns that several rows have, dealt by row."""
    held = yield from _gathered(batches, "dest", (1,))
    while held:
        block, rows = held.popitem()
        ids, sizes, row, tokens = _joined(rows)
        del rows
        tokens, row, degree = _counted(tokens, row, len(ids))
        if not len(tokens):
            continue
        order = np.argsort(row, kind="stable")
        row = row[order]
        yield _dealt(ids[row] % blocks, row, tokens[order], degree[order], ids, sizes, block)


_SETS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("set", pa.int64()), ("tokens", pa.binary()), ("keys", pa.list_(pa.int64())), ("family", pa.int64())])
_SETS_DDL = "kind int, key long, n long, set long, tokens binary, keys array<long>, family long"


def _survivors(batches: Iterator[pa.RecordBatch], blocks: int, percent: int):
    """Kind 0 as it is; kind 1: rows of the matrix that keep enough columns, these in the order of
    their degrees, and their minhash keys."""
    gathered = _gathered(batches, "dest", (1, 2))
    while True:
        try:
            b = next(gathered)
        except StopIteration as end:
            held = end.value
            break
        yield _batch(_SETS, b.num_rows, **{c: b.column(c) for c in ("kind", "key", "n", "set")})
    for rows in held.values():
        ids, sizes, row, tokens = _joined(rows)
        if not len(ids):
            continue
        blocks_of = np.repeat([r[0] for r in rows], [len(r[4]) // 5 for r in rows]).astype(np.uint64)
        degrees = np.frombuffer(b"".join(r[5] for r in rows), dtype="<u2")
        # A set that lies in several parts of the input brings its frequent columns with each.
        hot = np.flatnonzero(blocks_of == blocks)
        once = np.ones(len(row), dtype=bool)
        once[hot] = False
        once[hot[np.unique(row[hot] * APART + tokens[hot].astype(np.int64), return_index=True)[1]]] = True
        row, tokens, degrees, blocks_of = row[once], tokens[once], degrees[once], blocks_of[once]
        enough = np.bincount(row, minlength=len(ids)) >= least_common(sizes.astype(np.int64), percent)
        keep = enough[row]
        row, tokens, degrees = row[keep], mix(tokens[keep] * np.uint64(blocks + 1) + blocks_of[keep]) >> np.uint64(16), degrees[keep]
        order = np.lexsort((tokens, degrees, row))
        row, tokens = row[order], tokens[order]
        bounds = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else [0]
        out: dict[str, list] = {k: [] for k in ("n", "set", "tokens", "keys", "family")}
        for a, b in zip(bounds[:-1], bounds[1:]):
            out["family"].append(int(tokens[b - 1]))
            out["set"].append(int(ids[row[a]]))
            out["n"].append(int(sizes[row[a]]))
            out["tokens"].append(packed(tokens[a:b], 6))
            out["keys"].append([int((mix(tokens[a:b] + np.uint64(7919 * (i + 1)))).min() >> np.uint64(1)) for i in range(ROUNDS)])
        yield _batch(_SETS, len(out["n"]), kind=[1] * len(out["n"]), **out)


def _led(batches: Iterator[pa.RecordBatch], percent: int):
    """Compares each row with the leaders of its group, which come one after another; out go the
    edge to a leader, or the row if it has none."""
    group, leaders = None, []
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("set", "n", "tokens", "keys", "leader")}
        for g, salt, s, n, data, keys in zip(*(batch.column(c).to_pylist() for c in ("group", "salt", "set", "n", "tokens", "keys"))):
            if (g, salt) != group:
                group, leaders = (g, salt), []
            tokens = np.sort(unpacked(data, 6))
            found = None
            for leader, m, other in leaders:
                if 100 * min(n, m) >= percent * max(n, m):
                    at = np.searchsorted(other, tokens)
                    common = int((other[np.minimum(at, len(other) - 1)] == tokens).sum())
                    if linked(common, n, m, percent):
                        found = leader
                        break
            if found is None and len(leaders) < LEADERS:
                leaders.append((s, n, tokens))
            out["set"].append(s)
            out["n"].append(n)
            out["tokens"].append(data if found is None else None)
            out["keys"].append(keys if found is None else None)
            out["leader"].append(found)
        yield pa.RecordBatch.from_arrays([pa.array(out["set"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["tokens"], pa.binary()), pa.array(out["keys"], pa.list_(pa.int64())), pa.array(out["leader"], pa.int64())], names=["set", "n", "tokens", "keys", "leader"])


def _leader_rounds(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) from rows to leaders that they are linked with."""
    rest, edges = sets, None
    for i in range(ROUNDS):
        own = rest.withColumn("group", F.col("keys")[i])
        # A table of its own, so that its size is known and a small one is sent to the rows, not they to it.
        hot = written(own.groupBy("group").agg(F.count(F.lit(1)).alias("n_group")).where(F.col("n_group") > HOT))
        own = own.join(hot, "group", "left")
        salt = F.pmod(F.xxhash64("set"), F.coalesce(F.ceil(F.col("n_group") / HOT), F.lit(1)))
        own = own.select("group", salt.alias("salt"), "set", "n", "tokens", "keys").repartition("group", "salt").sortWithinPartitions("group", "salt", "set")
        led = written(own.mapInArrow(tidied(lambda b: _led(b, percent)), "set long, n long, tokens binary, keys array<long>, leader long"))
        found = led.where("leader IS NOT NULL").select(F.col("set").alias("a"), F.col("leader").alias("b"))
        edges = found if edges is None else edges.unionByName(found)
        rest = led.where("leader IS NULL").drop("leader")
    return edges


_POSTINGS_DDL = "dest int, blocks binary, sizes binary, classes binary, tokens binary"
_POSTINGS = pa.schema([("dest", pa.int32()), ("blocks", pa.binary()), ("sizes", pa.binary()), ("classes", pa.binary()), ("tokens", pa.binary())])


def _prefix(data: bytes, n: int, percent: int) -> bytes:
    """The columns among the first n - ceil(t*n) + 1, where those of a single row come first."""
    alone = n - len(data) // 6
    return data[: 6 * max(0, n - int(least_common(n, percent)) + 1 - alone)]


def _postings(batches: Iterator[pa.RecordBatch], dests: int):
    """The beginnings of rows, dealt by column."""
    for batch in batches:
        blocks, sizes, classes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "n", "class"))
        parts = [unpacked(d, 6) for d in batch.column("prefix").to_pylist()]
        if not parts:
            continue
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        tokens = np.concatenate(parts)
        dest = (tokens % np.uint64(dests)).astype(np.int64)
        order = np.argsort(dest, kind="stable")
        bounds = np.searchsorted(dest[order], np.arange(dests + 1))
        out: dict[str, list] = {f.name: [] for f in _POSTINGS}
        for d in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[d] : bounds[d + 1]]
            out["dest"].append(int(d))
            out["blocks"].append(blocks[row[own]].astype("<i8").tobytes())
            out["sizes"].append(sizes[row[own]].astype("<u4").tobytes())
            out["classes"].append(classes[row[own]].astype("<i8").tobytes())
            out["tokens"].append(packed(tokens[own], 6))
        yield _batch(_POSTINGS, len(out["dest"]), **out)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
_PAIRS_DDL = "a long, b long, left binary, right binary"


def _near_pairs(one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """The pairs of entries, by their numbers, that are near enough in size and not of one class alone.
    Columns of an entry: block, least and largest size, least and largest class."""
    x, y = one[:, None, :], two[None, :, :]
    near = (100 * y[..., 2] >= percent * x[..., 1]) & (100 * x[..., 2] >= percent * y[..., 1])
    return np.argwhere(near & ((x[..., 3] != y[..., 3]) | (x[..., 4] != y[..., 4]) | (x[..., 3] != y[..., 4])))


def _entries_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8").reshape(-1, 5)


def _block_pairs(batches: Iterator[pa.RecordBatch], percent: int):
    """The pairs of blocks with rows that share a column of their beginnings, are in different
    classes and near enough in size; of a column in many blocks pairs of chunks of these instead."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for r in zip(*(batch.column(f.name).to_pylist() for f in _POSTINGS)):
            held.setdefault(r[0], []).append(r[1:])
    while held:
        _, rows = held.popitem()
        blocks, sizes, classes = (np.frombuffer(b"".join(r[i] for r in rows), dtype=t) for i, t in ((0, "<i8"), (1, "<u4"), (2, "<i8")))
        tokens = unpacked(b"".join(r[3] for r in rows), 6)
        order = np.lexsort((blocks, tokens))
        blocks, sizes, classes, tokens = blocks[order], sizes[order].astype(np.int64), classes[order], tokens[order]
        bounds = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]])) if len(tokens) else np.zeros(1, dtype=np.int64)
        found: set[tuple[int, int]] = set()
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo < 2 or (classes[lo:hi] == classes[lo]).all():
                continue
            first = np.flatnonzero(np.concatenate([[True], blocks[lo + 1 : hi] != blocks[lo : hi - 1]]))
            size, c = sizes[lo:hi], classes[lo:hi]
            entries = np.stack([blocks[lo + first], np.minimum.reduceat(size, first), np.maximum.reduceat(size, first), np.minimum.reduceat(c, first), np.maximum.reduceat(c, first)], axis=1)
            if len(entries) > CHUNK:
                # In the order of their sizes, so that chunks of sizes too far apart never meet.
                entries = entries[np.lexsort((entries[:, 0], entries[:, 1]))].astype("<i8")
                parts = [entries[i : i + CHUNK] for i in range(0, len(entries), CHUNK)]
                for i, one in enumerate(parts):
                    for two in parts[i:]:
                        if 100 * one[:, 2].max() >= percent * two[:, 1].min():
                            yield _batch(_PAIRS, 1, left=[one.tobytes()], right=[two.tobytes()])
                continue
            found.update((int(entries[i, 0]), int(entries[j, 0])) for i, j in _near_pairs(entries, entries, percent) if i <= j)
            if len(found) > 500_000:
                yield _batch(_PAIRS, len(found), a=[x for x, _ in found], b=[y for _, y in found])
                found = set()
        if found:
            yield _batch(_PAIRS, len(found), a=[x for x, _ in found], b=[y for _, y in found])


def _chunk_pairs(batches: Iterator[pa.RecordBatch], percent: int):
    """The pairs of blocks of two chunks."""
    for batch in batches:
        for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
            one, two = _entries_of(left), _entries_of(right)
            at = _near_pairs(one, two, percent)
            a, b = one[at[:, 0], 0], two[at[:, 1], 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


_BLOCKS_DDL = "block long, sets binary, sizes binary, counts binary, tokens binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("sets", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])


def _blocked(batches: Iterator[pa.RecordBatch]):
    """Packs the rows of each block, which come one after another."""
    block, held = None, []

    def out():
        s, n, t = zip(*held)
        return _batch(_BLOCKS, 1, block=[block], sets=[np.array(s, dtype="<i8").tobytes()], sizes=[np.array(n, dtype="<u4").tobytes()], counts=[np.array([len(x) // 6 for x in t], dtype="<u4").tobytes()], tokens=[b"".join(t)])

    for batch in batches:
        for b, s, n, t in zip(*(batch.column(c).to_pylist() for c in ("block", "set", "n", "tokens"))):
            if b != block and held:
                yield out()
                held = []
            block = b
            held.append((s, n, t))
    if held:
        yield out()


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The product of two blocks; each is the rows' numbers and the tokens of its cells."""
    height, width = int(a[0].max(initial=-1)) + 1, int(b[0].max(initial=-1)) + 1
    total = np.zeros((height, width), dtype=np.float32)
    shared = np.intersect1d(a[1], b[1])
    cells = []
    for row, tokens in (a, b):
        at = np.minimum(np.searchsorted(shared, tokens), max(0, len(shared) - 1))
        hit = shared[at] == tokens if len(shared) else np.zeros(len(tokens), dtype=bool)
        order = np.argsort(at[hit], kind="stable")
        cells.append((row[hit][order], at[hit][order]))
    for lo in range(0, len(shared), COLUMNS):
        part = []
        for (row, at), size in zip(cells, (height, width)):
            i, j = np.searchsorted(at, [lo, lo + COLUMNS])
            m = np.zeros((size, min(COLUMNS, len(shared) - lo)), dtype=np.float32)
            m[row[i:j], at[i:j] - lo] = 1
            part.append(m)
        total += part[0] @ part[1].T
    return total.astype(np.int64)


def _multiplied(batches: Iterator[pa.RecordBatch], percent: int):
    """A spanning tree of the links within or between two blocks, as edges to roots."""
    for batch in batches:
        for r in batch.to_pylist():
            sides = []
            for x in "ab" if r["sets_b"] is not None else "a":
                counts = np.frombuffer(r[f"counts_{x}"], dtype="<u4")
                cells = np.repeat(np.arange(len(counts)), counts), unpacked(r[f"tokens_{x}"], 6)
                sides.append((np.frombuffer(r[f"sets_{x}"], dtype="<i8"), np.frombuffer(r[f"sizes_{x}"], dtype="<u4").astype(np.int64), cells))
            one, two = sides[0], sides[-1]
            hit = linked(overlaps(one[2], two[2]), one[1][:, None], two[1][None, :], percent)
            if len(sides) == 1:
                i, j = np.nonzero(np.triu(hit, 1))
                sets = one[0]
            else:
                i, j = np.nonzero(hit)
                j = j + len(one[0])
                sets = np.concatenate([one[0], two[0]])
            root = roots(len(sets), [(i, j)])
            own = np.flatnonzero(root != np.arange(len(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(sets[own]), pa.array(sets[root[own]])], names=["a", "b"])


def _other_edges(sets: DataFrame, edges: DataFrame, dests: int, percent: int) -> DataFrame:
    """Edges between classes that the leaders have not joined."""

    def prefixes(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            found = [_prefix(d, n, percent) for d, n in zip(b.column("tokens").to_pylist(), b.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("set"), b.column("n"), b.column("family"), pa.array(found, pa.binary())], names=["set", "n", "family", "prefix"])

    classes = components(edges).withColumnRenamed("id", "set")
    large = written(sets.groupBy("family").agg(F.count(F.lit(1)).alias("n_family")).where(F.col("n_family") > ROWS))

    def placed(rows: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("set"), F.coalesce(F.ceil(F.col("n_family") / ROWS), F.lit(1)))
        return rows.join(large, "family", "left").withColumn("block", F.xxhash64("family", part)).drop("n_family")

    begun = sets.select("set", "n", "family", "tokens").mapInArrow(prefixes, "set long, n long, family long, prefix binary")
    begun = placed(begun.join(classes, "set", "left")).select("block", "n", F.coalesce("component", "set").alias("class"), "prefix")
    dealt = begun.mapInArrow(tidied(lambda b: _postings(b, dests)), _POSTINGS_DDL).repartition("dest")
    listed = written(dealt.mapInArrow(tidied(lambda b: _block_pairs(b, percent)), _PAIRS_DDL))
    chunks = listed.where("left IS NOT NULL").select("left", "right").repartition(dests).mapInArrow(tidied(lambda b: _chunk_pairs(b, percent)), "a long, b long")
    pairs = written(listed.where("left IS NULL").select("a", "b").unionByName(chunks).distinct())
    named = pairs.select(F.explode(F.array("a", "b")).alias("block")).distinct()
    own = placed(sets.select("set", "n", "family", "tokens")).select("block", "set", "n", "tokens").join(named, "block", "left_semi")
    blocks = written(own.repartition("block").sortWithinPartitions("block", "set").mapInArrow(tidied(_blocked), _BLOCKS_DDL))
    side = lambda x: blocks.select(F.col("block").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in blocks.columns[1:]])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select(*[f"{c}_a" for c in blocks.columns[1:]], *[F.when(F.col("a") != F.col("b"), F.col(f"{c}_b")).alias(f"{c}_b") for c in blocks.columns[1:]])
    return both.mapInArrow(tidied(lambda b: _multiplied(b, percent)), "a long, b long")


def ngram_jaccard(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id: classes of documents of which each links with another of its
    class, by a Jaccard similarity of at least percent / 100."""
    own = picked(docs, key=docs[key].cast("long"), text=F.coalesce(docs[text], F.lit("")))
    n_rows, size = own.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(partitions(docs.sparkSession), -(-(size or 0) // BLOCK_TEXT))
    apart = frequent(own, width, n_rows)
    dealt = _incidence(own, width, blocks, apart).repartition(blocks, "dest")
    dealt = dealt.mapInArrow(tidied(lambda b: _shared(b, blocks)), _ROWS_DDL).repartition(blocks, "dest")
    kinds = written(dealt.mapInArrow(tidied(lambda b: _survivors(b, blocks, percent)), _SETS_DDL))
    rows, sets = kinds.where("kind = 0").select("key", "n", "set"), kinds.where("kind = 1").select("set", "n", "tokens", "keys", "family")
    edges = _leader_rounds(sets, percent)
    edges = written(edges.unionByName(_other_edges(sets, edges, blocks, percent)))
    of_set = components(edges).withColumnRenamed("id", "set")
    least = rows.where("n > 0 AND key IS NOT NULL").groupBy("set").agg(F.min("key").alias("least"))
    least = written(least.join(of_set, "set", "left").withColumn("component", F.coalesce("component", "set")))
    whole = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(whole, "component").select("set", "component_id")
    linked_rows = rows.where("n > 0 AND key IS NOT NULL").join(named, "set").select("key", "n", "component_id")
    alone = rows.where("n = 0 OR key IS NULL").select("key", "n", F.col("key").alias("component_id"))
    return linked_rows.unionByName(alone).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))


QUERIES = {"op5_ngram_jaccard": op5_ngram_jaccard}
ORACLES: dict = {}
