"""Operator 7: sampled encoding into pieces, and lossless decoding.

All segmentations of a text into a vocabulary's pieces form a lattice, in which a piece weighs
``exp(scale * score - cost)``.  Forward filtering sums the weights of all paths to each node;
backward sampling then walks from the end, and takes each edge with the share of its paths.  The
random numbers are hashes of the row key, the chunk's number and the step, so a row's segmentation
depends on nothing but its key, its text and the seed.

No piece crosses from a word into the blanks after it, so the lattice of a text falls into chunks of
blanks and the word behind them.  Distinct chunks of a part of the input are built and filtered
together, position by position, and all their occurrences are sampled together, step by step, in
numpy.  Characters that are no piece become byte pieces; so does a literal blank sign, so that
decoding gives every text back.

Defined cases: null texts give null ids; empty texts give no ids; a null key counts as 0; repeated
rows get the same ids; an empty table gives no rows; texts and chunks of any length are taken whole;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import kept_in_worker, picked, table, tidied

MODEL = "piece_bpe_32k.model"
SCALE, COST, SEED = 1e-4, 2.0, 7
#: Characters that are encoded together.
PART = 1 << 20
_BLANK, _LITERAL = 0x2581, 0x110001  # the sign for a blank, and what stands for that sign in a text
_R = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if n > 2 * PART:
        return _new_powers(n)
    one, other = kept_in_worker(("powers", PART), lambda: _new_powers(2 * PART))
    return one[:n], other[:n]


def _new_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for step in (_R, pow(_R, -1, 1 << 64)):
        p = np.ones(1, dtype=np.uint64)
        while len(p) < n:
            p, step = np.concatenate([p, p * np.uint64(step)]), step * step % (1 << 64)
        out.append(p[:n])
    return out[0], out[1]


def _prefixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any substring follows."""
    power, inverse = _powers(len(codes) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    return total, inverse


def _hashes(total: np.ndarray, inverse: np.ndarray, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Of substrings, by their place alone no different; tables take the upper bits of a product."""
    return (total[start + length] - total[start]) * inverse[start]


class Vocabulary:
    """pieces: id -> (text, score); bytes: byte -> id."""

    def __init__(self, pieces: dict[int, tuple[str, float]], bytes_: dict[int, int], scale: float = SCALE, cost: float = COST):
        self.cost, self.bytes = cost, bytes_
        self.longest = max(len(text) for text, _ in pieces.values())
        # All beginnings of pieces, those that are pieces with their id, the others with -1.
        of: dict[str, int] = {}
        for i, (text, _) in pieces.items():
            of[text] = i
            for n in range(1, len(text)):
                of.setdefault(text[:n], -1)
        self.hashes = np.zeros(len(of), dtype=np.uint64)
        self.ids = np.array(list(of.values()), dtype=np.int32)
        joined = np.array([ord(c) for text in of for c in text], dtype=np.uint32)
        length = np.array([len(text) for text in of])
        start = np.cumsum(length) - length
        total, inverse = _prefixes(joined)
        self.hashes = _hashes(total, inverse, start, length)
        self.log = np.array([scale * pieces[i][1] - cost if i >= 0 else 0.0 for i in of.values()])
        # Tables of 2**20 places by different bits of the hash; what finds its place taken goes to
        # the next one.
        self.tables: list[np.ndarray] = []
        rest = np.arange(len(of), dtype=np.int32)
        while len(rest):
            spot = self._spot(self.hashes[rest], len(self.tables))
            table = np.full(1 << 20, -1, dtype=np.int32)
            table[spot] = rest
            rest = rest[table[spot] != rest]
            self.tables.append(table)
        self.raw: dict[int, bytes] = {i: text.replace(chr(_BLANK), " ").encode() for i, (text, _) in pieces.items()} | {i: bytes([b]) for b, i in bytes_.items()}

    @staticmethod
    def _spot(hashes: np.ndarray, table: int) -> np.ndarray:
        return ((hashes * np.uint64((_R + 2 * table * 0x5851F42D) % (1 << 64))) >> np.uint64(44)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each beginning, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        rest = np.arange(len(hashes))
        for k, table in enumerate(self.tables):
            h = hashes if k == 0 else hashes[rest]
            i = table[self._spot(h, k)]
            some = np.flatnonzero(i >= 0)  # most places are empty
            hit = self.hashes[i[some]] == h[some]
            out[rest[some[hit]]] = i[some[hit]]
            rest = rest[some[~hit]]
            if not len(rest):
                break
        return out

    def decode(self, ids) -> str:
        data = b"".join(map(self.raw.__getitem__, ids))
        return data[1:].decode()  # without the blank that encoding puts first


def vocabulary(model: str = MODEL, scale: float = SCALE, cost: float = COST) -> Vocabulary:
    def make() -> Vocabulary:
        import os

        import public_tokenizers
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model if os.path.isabs(model) else public_tokenizers.path(model))
        pieces, bytes_ = {}, {}
        for i in range(p.get_piece_size()):
            if p.is_byte(i):
                bytes_[int(p.id_to_piece(i)[3:5], 16)] = i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                pieces[i] = p.id_to_piece(i), p.get_score(i)
        return Vocabulary(pieces, bytes_, scale, cost)

    return kept_in_worker(("pieces", model, scale, cost), make)


def _codes(text: str) -> np.ndarray:
    """Code points after one blank more, with blanks as their sign."""
    c = np.frombuffer((" " + text).encode("utf-32-le"), dtype="<u4").copy()
    c[c == _BLANK] = _LITERAL
    c[c == 32] = _BLANK
    return c


def _fallback(code: int, v: Vocabulary) -> list[int]:
    return [v.bytes[b] for b in chr(_BLANK if code == _LITERAL else code).encode()]


class Lattice:
    """The edges of distinct chunks; nodes are numbered through, one more a chunk than characters."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, v: Vocabulary):
        lengths = np.diff(np.append(starts, len(codes)))
        chunk = np.repeat(np.arange(len(starts)), lengths)
        left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))  # characters to the chunk's end
        node = np.arange(len(codes)) + chunk
        chunk_of_node = np.repeat(np.arange(len(starts)), lengths + 1)
        self.first, self.last = starts + np.arange(len(starts)), starts + lengths + np.arange(len(starts))
        total, inverse = _prefixes(codes)
        a, b, ids, weight = [], [], [], []
        single = np.zeros(len(codes), dtype=bool)
        at = np.arange(len(codes))
        for n in range(1, v.longest + 1):
            at = at[left[at] >= n]
            if not len(at):
                break
            i = v.find(_hashes(total, inverse, at, n))
            at, i = at[i >= 0], i[i >= 0]
            whole = v.ids[i] >= 0
            own, i = at[whole], i[whole]
            if n == 1:
                single[own] = True
            a.append(node[own])
            b.append(node[own] + n)
            ids.append(v.ids[i])
            weight.append(v.log[i])
        # Characters that are no piece: one edge of several byte pieces, numbered below zero.
        rest = np.flatnonzero(~single)
        kinds, of = np.unique(codes[rest], return_inverse=True)
        self.spelt = [_fallback(int(c), v) for c in kinds]
        a.append(node[rest])
        b.append(node[rest] + 1)
        ids.append((-1 - of).astype(np.int32))
        weight.append(np.array([-2 * v.cost * len(s) for s in self.spelt])[of] if len(rest) else np.zeros(0))
        a, b, ids, weight = map(np.concatenate, (a, b, ids, weight))
        position = b - self.first[chunk_of_node[b]]
        self._filter(position, a, b, ids, weight)

    def _filter(self, position: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> None:
        """Forward sums, position by position in all chunks, and each edge's share at its end."""
        # By position in the chunk, then by end: edges of one end lie together.
        bits = int(b.max(initial=1)).bit_length()
        if bits + int(position.max(initial=1)).bit_length() <= 52:
            order = np.argsort(position << (bits + 11) | b << 11 | np.minimum(b - a, 2047))
        else:
            order = np.lexsort((b - a, b, position))
        self.start, end, self.ids, weight, position = a[order], b[order], ids[order], weight[order], position[order]
        new = np.ones(len(end), dtype=bool)
        np.not_equal(end[1:], end[:-1], out=new[1:])
        heads = np.flatnonzero(new)  # the first edge of each end
        sizes = np.diff(np.append(heads, len(end)))
        forward = np.zeros(int(self.last[-1]) + 1 if len(self.last) else 0)
        self.edge = np.zeros(len(forward), dtype=np.int64)
        self.edge[end[heads]] = heads
        level = position[heads]
        cuts = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1], [True]])) if len(level) else [0]
        share = np.empty(len(weight))
        for i, j in zip(cuts[:-1], cuts[1:]):
            lo, hi = heads[i], heads[j - 1] + sizes[j - 1]
            first, size = heads[i:j] - lo, sizes[i:j]
            x = forward[self.start[lo:hi]] + weight[lo:hi]
            top = np.maximum.reduceat(x, first)
            p = np.exp(x - np.repeat(top, size))
            total = np.add.reduceat(p, first)
            forward[end[heads[i:j]]] = top + np.log(total)
            p = np.cumsum(p / np.repeat(total, size))
            p -= np.repeat(np.concatenate([[0.0], p[first[1:] - 1]]), size)
            p[first + size - 1] = 1.0  # the last edge takes what rounding leaves
            share[lo:hi] = p
        #: Of each edge the share of it and of those before it at the same end.
        self.share = share

    def sample(self, chunk: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges of all occurrences in reading order, how many each has); chunk: its chunk's
        number, seed: its random state."""
        node, live = self.last[chunk].copy(), np.arange(len(chunk))
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(chunk), dtype=np.int64)
        step = 0
        while len(live):
            u = (mix(seed[live] + np.uint64((step + 1) * 0xD1B54A32D192ED03 % (1 << 64))) >> np.uint64(24)).astype(np.float64) / float(1 << 40)
            e = self.edge[node[live]]
            on = np.flatnonzero(self.share[e] <= u)
            while len(on):
                e[on] += 1
                on = on[self.share[e[on]] <= u[on]]
            taken.append((live, e))
            count[live] += 1
            node[live] = self.start[e]
            live = live[node[live] != self.first[chunk[live]]]
            step += 1
        offset = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), dtype=np.int64)
        for s, (which, e) in enumerate(taken):
            out[offset[which] + count[which] - 1 - s] = e
        return out, count


def encode(texts: list[str], keys: np.ndarray, v: Vocabulary, seed: int = SEED) -> list[np.ndarray]:
    """The sampled ids of each text."""
    parts = [_codes(t) if t else np.zeros(0, dtype=np.uint32) for t in texts]
    codes = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
    if not len(codes):
        return [np.zeros(0, dtype=np.int32) for _ in texts]
    size = np.array([len(p) for p in parts])
    begin = np.cumsum(size) - size
    blank = codes == _BLANK
    start = blank & ~np.concatenate([[False], blank[:-1]])
    start[begin[size > 0]] = True
    starts = np.flatnonzero(start)
    lengths = np.diff(np.append(starts, len(codes)))
    total, inverse = _prefixes(codes)
    h = _hashes(total, inverse, starts, lengths) ^ lengths.astype(np.uint64)
    _, first, chunk = np.unique(h, return_index=True, return_inverse=True)
    size_of = lengths[first]
    begin_of = np.cumsum(size_of) - size_of
    own = codes[np.arange(int(size_of.sum())) + np.repeat(starts[first] - begin_of, size_of)]
    lattice = Lattice(own, begin_of, v)
    doc = np.searchsorted(begin + size, starts, side="right")
    number = np.arange(len(starts)) - np.searchsorted(doc, doc)
    state = mix(mix(keys.astype(np.uint64) + np.uint64(seed) * np.uint64(0xA0761D6478BD642F % (1 << 63)))[doc] + number.astype(np.uint64) * np.uint64(_R))
    edges, count = lattice.sample(chunk, state)
    ids = lattice.ids[edges]
    if lattice.spelt:
        spelt = ids < 0
        width = np.ones(len(ids), dtype=np.int64)
        lens = np.array([len(s) for s in lattice.spelt])
        width[spelt] = lens[-1 - ids[spelt]]
        flat = np.repeat(ids, width)
        if spelt.any():
            offset = np.cumsum(width) - width
            for k in np.unique(ids[spelt]):
                at = offset[ids == k]
                for j, piece in enumerate(lattice.spelt[-1 - k]):
                    flat[at + j] = piece
        per_chunk = np.add.reduceat(width, np.cumsum(count) - count)
        ids = flat
    else:
        per_chunk = count
    n = np.bincount(doc, weights=per_chunk, minlength=len(texts)).astype(np.int64)
    return np.split(ids, np.cumsum(n)[:-1])


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, scale: float = SCALE, cost: float = COST, seed: int = SEED) -> DataFrame:
    """key, ids, lossless: sampled ids, and whether decoding them gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]):
        v = vocabulary(model, scale, cost)
        for batch in batches:
            keys = batch.column("key").fill_null(0).to_numpy()
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= PART):
                    size += len(texts[end] or "")
                    end += 1
                own = texts[at:end]
                ids = encode([t or "" for t in own], keys[at:end], v, seed)
                good = [None if t is None else v.decode(i.tolist()) == t for t, i in zip(own, ids)]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                none = pa.array([t is None for t in own])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)), mask=none)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, end - at), lists, pa.array(good, pa.bool_())], names=["key", "ids", "lossless"])
                at = end

    own = picked(docs, key=docs[key].cast("long"), text=text)
    return own.mapInArrow(tidied(run), "key long, ids array<int>, lossless boolean").withColumnRenamed("key", key)


def decoded(rows: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """key, text."""

    def run(batches: Iterator[pa.RecordBatch]):
        v = vocabulary(model)
        for batch in batches:
            texts = [None if i is None else v.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    return picked(rows, key=rows[key].cast("long"), ids=ids).mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "lossless")


QUERIES = {"op7_pieces": op7_pieces}
ORACLES: dict = {}
