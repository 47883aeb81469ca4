"""Runs of words that texts share: no place where windows meet is listed, and no pair is shuffled.

A window is a run of ``size`` words.  What is read and dealt:

1. Of every window the least hash of its runs of about ``size`` / 2 words, its anchor; neighbouring windows
   mostly have the same one, so that about an eighth as many go on.  Windows that texts share have shared
   anchors.  Which anchors occur twice is a table of BITS bits, whatever the data: where it fills up, more
   windows pass it, and no shared one is lost.
2. The windows whose anchor may be shared, by their hash.  In its group a window is an opening one if the
   words before its members differ, and a closing one if the words after them do; the others lie within
   whatever runs go through them, and go no further.
3. Opening and closing windows, packed in blocks of whole texts, to pairs of blocks.  Two texts' run begins
   at a common opening window with different words before it, and ends at the first common closing one with
   different words after it, so all runs of a pair of texts are made in one task, part by part, from data
   that is linear in the windows.  Places with equal words before them are never met: what a task lists is
   what it returns.  Very common windows are every task's, none's alone.  A block has a fixed number of rows,
   so a task's memory doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.tables import written

#: Parts that anchors and windows are dealt to; bits of the table of anchors, and of each part's share of it.
PARTS, BITS, SHARE = 256, 1 << 26, 1 << 18
#: Words that are hashed at once; pairs that are made at once; rows of a block of texts, and those of
#: them that are packed together.
WORDS, PAIRS, BLOCK, PACKED = 1 << 20, 1 << 16, 1 << 20, 1 << 17
#: Blocks of few rows: the least, one more for so many rows, and up to how many.
LEAST_BLOCKS, FEW, SOME_BLOCKS = 6, 1 << 12, 16
#: Places that are compared in spans have spans of up to 2**LEVELS of them.
LEVELS = 8
#: Bytes of texts that are split at once, and of words that are hashed at once.
BYTES, SLICE = 1 << 22, 1 << 16
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\r\f"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(BASES[1])
    return x ^ (x >> np.uint64(29))


#: A number for each byte of a word.
_NUMBERS = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0])))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    each = (np.full(n, b, dtype=np.uint64) for b in (BASES[1], pow(BASES[1], -1, 1 << 64)))
    return tuple(np.multiply.accumulate(np.append(np.uint64(1), x[1:])) for x in each)


def split_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of texts, whose bytes stand together and end at ``ends``, and how many words each
    text has.  As functions.words: words are what white space parts."""
    gap = _IS_SPACE[data]
    first = ~gap
    first[1:] &= gap[:-1]
    last = ~gap
    last[:-1] &= gap[1:]
    bounds = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(data))]
    first[bounds] |= ~gap[bounds]  # a text's end parts words, too
    last[bounds - 1] |= ~gap[bounds - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(max(SLICE, int((end - begin).max(initial=0))))
    out = np.empty(len(begin), dtype=np.uint64)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + SLICE, "right")))
        lo, hi = begin[at], end[to - 1]
        sums = np.append(np.uint64(0), np.cumsum(_NUMBERS[data[lo:hi]] * power[: hi - lo], dtype=np.uint64))
        out[at:to] = (sums[end[at:to] - lo] - sums[begin[at:to] - lo]) * inverse[begin[at:to] - lo]
        at = to
    return _mixed(out), np.diff(np.searchsorted(begin, ends), prepend=0)


def rolled(x: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """Hashes of all runs of ``size`` numbers: the digits of a number to an odd base, modulo 2**64."""
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    out, done, span, width = None, 0, x, 1
    while True:
        if size & width:
            out = span if out is None else out[: max(0, len(span) - done)] + power(done) * span[done : done + len(out)]
            done += width
        if done == size:
            break
        span, width = span[:-width] + power(width) * span[width:], 2 * width
    return _mixed(out)


def least_of(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every run of ``size`` numbers."""
    width = 1
    while 2 * width <= size:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    rest = size - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _words(column: pa.Array):
    """(first row, words, bounds of each row) for some rows of a column of texts or of lists of hashes."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        yield 0, np.asarray(column.values).astype(np.int64).view(np.uint64), np.asarray(column.offsets).astype(np.int64)
        return
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BYTES, "right")) - 1)
        words, lens = split_words(data[ends[at] : ends[to]], ends[at + 1 : to + 1] - ends[at])
        yield at, words, np.append(0, np.cumsum(lens))
        at = to


def _texts(batch: pa.RecordBatch, size: int):
    """(text of each word, its end, words) for some texts of a batch at a time, and only long enough ones."""
    for first, words, ends in _words(batch.column("w")):
        for text, end, x in _long_texts(words, ends, size):
            yield text + first, end, x


def _long_texts(words: np.ndarray, ends: np.ndarray, size: int):
    lens = np.diff(ends)
    long = np.flatnonzero(lens >= size)
    group = np.cumsum(lens[long]) // WORDS
    for own in np.split(long, np.flatnonzero(np.diff(group)) + 1):
        if len(own):
            x = np.concatenate([words[ends[i] : ends[i + 1]] for i in own])
            yield np.repeat(own, lens[own]), np.repeat(np.cumsum(lens[own]), lens[own]), np.maximum(x, np.uint64(1))


def _starts(end: np.ndarray, size: int) -> np.ndarray:
    """Where windows begin: they end within their text."""
    return np.flatnonzero(np.arange(len(end) - size + 1) + size <= end[: len(end) - size + 1])


def _anchors(words: np.ndarray, size: int) -> np.ndarray:
    some = (size + 1) // 2
    return least_of(rolled(words, some), size - some + 1)


def _packed(c: np.ndarray) -> bytes:
    """A column's bytes; those of equal weight stand together, as they are packed better."""
    return np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T).tobytes()


def _unpacked(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(b.as_buffer(), np.uint8).reshape(size, -1).T).view(kind).ravel() for b in column])


def _dealt(part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each part, with the bytes of its columns."""
    order = np.argsort(part.astype(np.uint8), kind="stable")
    at = np.append(0, np.cumsum(np.bincount(part, minlength=PARTS)))
    own = [i for i in range(PARTS) if at[i] < at[i + 1]]
    out = {"part": pa.array(own, pa.int32())}
    for i, c in enumerate(columns):
        c = c[order]
        out[f"c{i}"] = pa.array([_packed(c[at[p] : at[p + 1]]) for p in own], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def _column(rows: pa.Table, i: int, kind: str) -> np.ndarray:
    return _unpacked(rows.column(f"c{i}"), kind)


def hashed(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x)).alias("w")


def _shared_anchors(own: DataFrame, size: int):
    """The table of anchors that occur twice, for all tasks: PARTS shares of fixed size reach the driver."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, end, words in _texts(batch, size):
                at = _starts(end, size)
                a, t = _anchors(words, size)[at], text[at]
                a = a[np.append(True, (a[1:] != a[:-1]) | (t[1:] != t[:-1]))]
                yield _dealt((a >> np.uint64(56)).astype(np.int32), a)

    def several(rows: pa.Table) -> pa.Table:
        a = np.sort(_column(rows, 0, "u8"))
        bits = np.zeros(SHARE, dtype=np.uint8)
        bits[(a[1:][a[1:] == a[:-1]] >> np.uint64(38)).astype(np.int64) & (SHARE - 1)] = 1
        return pa.table({"part": rows.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    found = own.select("w").mapInArrow(anchors, "part int, c0 binary").groupBy("part").applyInArrow(several, "part int, bits binary")
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for r in found.collect():  # in one job; toLocalIterator has one for each partition, after another
        bits[r.part * (SHARE // 8) : (r.part + 1) * (SHARE // 8)] = np.frombuffer(r.bits, np.uint8)
    return own.sparkSession.sparkContext.broadcast(bits)


def _windows(own: DataFrame, size: int, places: bool) -> DataFrame:
    """The windows that may be shared, dealt by their hash: two hashes, text, and on demand place, word
    before and word after (0 if there is none)."""
    known = _shared_anchors(own, size)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in batches:
            names = np.asarray(batch.column("t"))
            for text, end, words in _texts(batch, size):
                at = _starts(end, size)
                a = (_anchors(words, size)[at] >> np.uint64(38)).astype(np.int64)
                at = at[(bits[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & 1 == 1]
                h = rolled(words, size)[at]
                columns = [h, (rolled(words, size, BASES[1])[at] >> np.uint64(32)).astype(np.uint32), names[text[at]]]
                if places:
                    first = np.append(True, text[1:] != text[:-1])
                    begin = np.flatnonzero(first)[np.cumsum(first) - 1][at]
                    before = np.where(at > begin, words[at - 1], np.uint64(0))
                    after = np.where(at + size < end[at], words[np.minimum(at + size, len(words) - 1)], np.uint64(0))
                    columns += [(at - begin).astype(np.int32), before, after]
                if len(at):
                    yield _dealt((h >> np.uint64(56)).astype(np.int32), *columns)

    kinds = ", ".join(f"c{i} binary" for i in range(6 if places else 3))
    return own.select("t", "w").mapInArrow(windows, f"part int, {kinds}").groupBy("part")


def _named(own: DataFrame) -> DataFrame:
    return own.where("w IS NOT NULL")


def shared_counts(own: DataFrame, size: int) -> DataFrame:
    """n_docs, n_windows: how many windows so many texts of own(t, w) share; t names a text, w has its
    words' hashes, and rows of one t are one text."""

    def counts(rows: pa.Table) -> pa.Table:
        h1, h2, t = (_column(rows, i, k) for i, k in enumerate(("u8", "u4", "i8")))
        order = np.lexsort((t, h2, h1))
        h1, h2, t = h1[order], h2[order], t[order]
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        other = new | np.append(True, t[1:] != t[:-1])
        n, times = np.unique(np.add.reduceat(other.astype(np.int64), np.flatnonzero(new)), return_counts=True)
        return pa.table({"n_docs": n[n > 1], "n_windows": times[n > 1].astype(np.int64)})

    found = _windows(_named(own), size, False).applyInArrow(counts, "n_docs long, n_windows long")
    return found.groupBy("n_docs").agg(F.sum("n_windows").alias("n_windows"))


def _codes(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that tell values of a group apart, 0 for the value 0, and whether a group has several or
    rows of value 0, which differ from each other; groups are numbered upwards."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.append(True, g[1:] != g[:-1])
    step = np.cumsum(np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])))
    code = np.zeros(len(g), dtype=np.int32)
    code[order] = np.where(v == 0, 0, step - step[np.flatnonzero(new)][np.cumsum(new) - 1] + 1)
    least, most = (f.reduceat(v, np.flatnonzero(new)) for f in (np.minimum, np.maximum))
    return code, (least != most) | (least == 0)


def _ends(rows: pa.Table) -> pa.Table:
    """t, pos, g, before, after: opening windows have a number of their group and a code of the word before
    them, closing ones a code of the word after; else these are -1."""
    h1, h2, t, pos, before, after = (_column(rows, i, k) for i, k in enumerate(("u8", "u4", "i8", "i4", "u8", "u8")))
    order = np.lexsort((pos, t, h2, h1))
    h1, h2, t, pos, before, after = (x[order] for x in (h1, h2, t, pos, before, after))
    new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
    once = new | np.append(True, (t[1:] != t[:-1]) | (pos[1:] != pos[:-1]))  # copies of a text have one t
    h1, t, pos, before, after, new = (x[once] for x in (h1, t, pos, before, after, new))
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    shared = (np.minimum.reduceat(t, at) != np.maximum.reduceat(t, at))[group]
    t, pos, before, after, group = (x[shared] for x in (t, pos, before, after, group))
    if not len(t):
        return pa.table({"t": t, "pos": pos, "g": group, "before": pos, "after": pos})
    group = np.cumsum(np.append(0, np.diff(group) > 0))
    (b, opens), (a, closes) = _codes(group, before), _codes(group, after)
    opens, closes = opens[group], closes[group]
    own = opens | closes
    part = np.int64(rows.column("part")[0].as_py()) << np.int64(40)
    return pa.table({"t": t[own], "pos": pos[own], "g": (part + group)[own], "before": np.where(opens, b, -1)[own].astype(np.int32), "after": np.where(closes, a, -1)[own].astype(np.int32)})


def _block(rows: pa.Table) -> pa.Table:
    """A block's texts, whole ones packed together: block, their keys, and bytes of how many rows each has and
    of the rows by text and place."""
    t, pos = (rows.column(c).to_numpy() for c in ("t", "pos"))
    order = np.lexsort((pos, t))
    at = np.flatnonzero(np.append(True, np.diff(t[order]) != 0))
    n = np.diff(np.append(at, len(t)))
    first = np.append(np.flatnonzero(np.append(True, np.diff(at // PACKED) > 0)), len(at))
    ends = np.append(at, len(t))[first]
    out = {"block": rows.column("block").slice(0, len(first) - 1), "keys": [], "n": [_packed(n[a:b].astype(np.int32)) for a, b in zip(first, first[1:])]}
    keys = rows.column("key").take(pa.array(order[at])).combine_chunks()
    out["keys"] = pa.ListArray.from_arrays(pa.array(first, pa.int32()), keys)
    for c in ("pos", "g", "before", "after"):
        x = rows.column(c).to_numpy()[order]
        out[c] = [_packed(x[a:b]) for a, b in zip(ends, ends[1:])]
    return pa.table(out)


def _spans(code: np.ndarray, most: int) -> list[np.ndarray]:
    """Of each place the hash of the 1, 2, 4 ... numbers from there on, as many as ``most`` at least or 2**LEVELS; a
    0 differs from all others, and so do spans beyond the end."""
    alone = lambda n, i: ~_mixed(np.arange(i, i + n, dtype=np.uint64))
    out = [np.where(code == 0, alone(len(code), 1), _mixed(code.astype(np.uint64)))]
    while len(out) <= LEVELS and 1 << (len(out) - 1) < most:
        width = 1 << (len(out) - 1)
        span = out[-1].copy()
        span[:-width] = _mixed(out[-1][:-width] * np.uint64(BASES[0])) + out[-1][width:]
        out.append(span)
    return out


def _unlike(spans: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many numbers from a and from b on are the same: not one after another, but in spans."""
    out = np.zeros(len(a), dtype=np.int32)
    left = np.flatnonzero(spans[0][a] == spans[0][b])
    a, b = a[left], b[left]
    done = np.zeros(len(left), dtype=np.int32)
    on, top = np.arange(len(left)), np.int32(1 << (len(spans) - 1))
    while len(on):  # the longest spans, as often as they are the same
        on = on[spans[-1][a[on] + done[on]] == spans[-1][b[on] + done[on]]]
        done[on] += top
    a, b = a + done, b + done
    for k in range(len(spans) - 2, -1, -1):
        step = (spans[k][a] == spans[k][b]).astype(np.int32) << np.int32(k)
        a, b, done = a + step, b + step, done + step
    out[left] = done
    return out


def _first(code: np.ndarray, length: np.ndarray, several: int) -> np.ndarray:
    """Where the rows of the greatest length of each code stand, by code; all rows, if numbers are too large."""
    most = int(length.max()) + 1
    if several * most >= 1 << 63:
        return np.argsort(code, kind="stable")
    key = code * most + (most - 1 - length)
    order = np.argsort(key)
    code, key = code[order], key[order]
    new = np.append(True, code[1:] != code[:-1])
    return order[key == key[new][np.cumsum(new) - 1]]


def _met(xs: np.ndarray, ys: np.ndarray, g: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of xs, and ys in order: each meets those of its number, from ``first`` on, but not those with the same
    word before them, of which there are ``skipped`` from ``skip`` on; n are left."""
    ys = ys[np.lexsort((before[ys], g[ys]))]
    numbers, at = np.unique(g[ys], return_index=True)
    xs = xs[np.isin(g[xs], numbers)]
    at = np.append(at, len(ys))
    number = np.searchsorted(numbers, g[xs])
    first, n = at[number], at[number + 1] - at[number]
    code = (np.repeat(np.arange(len(numbers)), np.diff(at)) << 32) + before[ys]
    own = (number << 32) + before[xs]
    skip = np.searchsorted(code, own)
    skipped = np.where(before[xs] == 0, 0, np.searchsorted(code, own, "right") - skip)
    return xs, ys, first, skip, skipped, n - skipped


def _runs(rows: list[pa.RecordBatch], size: int, longest: bool, blocks: int) -> Iterator[pa.RecordBatch]:
    """The runs between the texts of two blocks, or within one.  If one of two has no texts there are none:
    those within the other are another pair's."""
    all_ = pa.Table.from_batches(rows)
    lo, hi = divmod(all_.column("pair")[0].as_py(), blocks)
    block = all_.column("block").to_numpy()
    if (block.min(), block.max()) != (lo, hi):
        return
    order = np.argsort(block, kind="stable")
    all_, block = all_.take(pa.array(order)), block[order]
    pos, g, before, after = (_unpacked(all_.column(c), k) for c, k in (("pos", "i4"), ("g", "i8"), ("before", "i4"), ("after", "i4")))
    n = _unpacked(all_.column("n"), "i4")
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    keys = all_.column("keys").combine_chunks().flatten()
    rank = pc.rank(keys, tiebreaker="dense").to_numpy().astype(np.int64)
    lower = np.repeat(block, pc.list_value_length(all_.column("keys")).to_numpy())[doc] == lo
    of = rank[doc]
    unlike = lo != hi and int(rank.max()) == len(rank)  # no two texts have one key
    closing = after >= 0
    last_pos, last = pos[closing], after[closing]
    reach = (np.cumsum(closing) - closing).astype(np.int32)  # of each row the first closing one from there on
    xs = np.flatnonzero((before >= 0) & lower).astype(np.int32)
    ys = xs if lo == hi else np.flatnonzero((before >= 0) & ~lower).astype(np.int32)
    xs, ys, first, skip, skipped, n = _met(xs, ys, g, before)
    if not len(xs):
        return
    spans = _spans(last, int(np.bincount(doc[closing]).max()))
    total = np.append(0, np.cumsum(n))
    cut = np.unique(np.searchsorted(total, np.arange(0, total[-1], PAIRS)[1:], "left")).tolist()
    kept = [np.zeros(0, dtype=np.int64)] * 3  # of a text whose pairs go on in the next part, the longest so far
    for r0, r1 in zip([0, *cut], [*cut, len(xs)]):
        k = n[r0:r1]
        x = np.repeat(xs[r0:r1], k)
        y = np.arange(len(x)) + np.repeat(first[r0:r1] - (total[r0:r1] - total[r0]), k)
        y += np.where(y >= np.repeat(skip[r0:r1], k), np.repeat(skipped[r0:r1], k), 0)
        y = ys[y]
        if not unlike:
            is_one = of[x] < of[y] if lo == hi else of[x] != of[y]
            x, y = x[is_one], y[is_one]
        a = reach[x]
        length = last_pos[a + _unlike(spans, a, reach[y])].astype(np.int64) - pos[x] + size
        if longest and len(kept[0]) + len(x):
            x, y, length = (np.concatenate(v) for v in zip(kept, (x, y, length)))
            dx, dy = doc[x].astype(np.int64), doc[y].astype(np.int64)
            low = int(dx.min())
            best = _first((dx - low) * len(rank) + dy, length, (int(dx.max()) - low + 1) * len(rank))
            x, y, length, dx, dy = (v[best] for v in (x, y, length, dx, dy))
            same = (dx[1:] == dx[:-1]) & (dy[1:] == dy[:-1])
            if same.any():
                turned = of[x] > of[y]
                order = np.lexsort((np.where(turned, pos[x], pos[y]), np.where(turned, pos[y], pos[x]), -length, dy, dx))
                order = order[np.append(True, ~same)]
                x, y, length, dx = (v[order] for v in (x, y, length, dx))
            on = dx == doc[xs[r1]] if r1 < len(xs) else np.zeros(len(x), dtype=bool)
            kept = [v[on] for v in (x, y, length)]
            x, y, length = (v[~on] for v in (x, y, length))
        turned = of[x] > of[y]
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        for i in range(0, len(x), 1 << 16):
            p, q = x[i : i + (1 << 16)], y[i : i + (1 << 16)]
            columns = [keys.take(pa.array(doc[p])), keys.take(pa.array(doc[q])), *(pa.array(v.astype(np.int64)) for v in (pos[p], pos[q], length[i : i + (1 << 16)]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_a", "doc_b", "start_a", "start_b", "n_tokens"])


def common_runs(own: DataFrame, size: int, longest: bool = False) -> DataFrame:
    """doc_a, doc_b, start_a, start_b, n_tokens: all maximal runs of at least ``size`` words that two texts
    of own(key, t, w) share, or of each pair the longest (the first of equal ones).  t names a text, w has
    its words' hashes, or the text itself, whose words white space parts; rows of one t are one text, named
    by its smallest key."""
    own = _named(own.where("key IS NOT NULL"))
    kind = own.schema["key"].dataType.simpleString()
    ends = written(_windows(own, size, True).applyInArrow(_ends, "t long, pos int, g long, before int, after int"))
    n = ends.count()
    blocks = max(min(SOME_BLOCKS, LEAST_BLOCKS + n // FEW), -(-n // BLOCK))
    named = own.groupBy("t").agg(F.min("key").alias("key"))
    at = ends.join(named, "t").withColumn("block", F.pmod(F.xxhash64("t"), F.lit(blocks)).cast("int"))
    columns = ", ".join(f"{c} binary" for c in ("n", "pos", "g", "before", "after"))
    at = at.groupBy("block").applyInArrow(_block, f"block int, keys array<{kind}>, {columns}")
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    at = at.withColumn("pair", F.least("block", "other") * blocks + F.greatest("block", "other")).drop("other")

    def runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _runs(list(rows), size, longest, blocks)

    dealt = at.repartition(blocks * (blocks + 1), "pair").groupBy("pair")
    return dealt.applyInArrow(runs, f"doc_a {kind}, doc_b {kind}, start_a long, start_b long, n_tokens long")
