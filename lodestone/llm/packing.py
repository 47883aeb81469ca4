"""Operator 10: packing of token sequences by bin completion with branch and bound.

Documents are tokenised whole; each gets an end id, and one longer than a sequence is cut so that
only its first piece is shorter than a full sequence.  The packing itself never sees single pieces:
it works on how many pieces there are of each length, at most ``capacity`` numbers whatever the
data's size.  Around the longest remaining length it enumerates fillings that no other filling
dominates, takes the one with least waste as often as the counts allow, and backtracks while the
waste so far still permits fewer sequences than the incumbent, which a best-fit solution gives
first.  It ends when the incumbent meets the lower bound or after a fixed number of nodes.

Every row says how many sequences there are and how many any packing needs at least, so that a search
which ended early can be told from one that met its bound.

Pieces then find their places by their rank among the pieces of their length.  Ranks are counted
within groups of a length, the more of them the more pieces there are, so that a length which a third
of all pieces share is not one task's.

Defined cases: null texts count as empty and give one piece, the end id; long texts are tokenised whole;
repeated rows are packed each; an empty table gives no rows; other input columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import kept_in_worker, picked, table, tidied, written

CAPACITY = 2048
END_ID = 0
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
#: Groups of a length at least, and pieces for each group of larger inputs.
GROUPS, PER_GROUP = 256, 1 << 16
#: Bounds of the search: fillings tried for one bin, alternatives kept for it, nodes in all.
FILLINGS, ALTERNATIVES, NODES = 400, 4, 20_000


def _file(name: str) -> str:
    import os

    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS):
    """text -> numpy ids, equal to those of ``tokenizers`` without added special tokens.

    The rank file holds the same vocabulary and merges for a faster library; a text that holds a
    special token's string goes through ``tokenizers`` itself.
    """

    def make():
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(_file(ranks), "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        slow = Tokenizer.from_file(_file(vocabulary))

        def encode(text: str) -> np.ndarray:
            if SPECIAL in text:
                return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
            return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4")

        return encode

    return kept_in_worker(("encoder", vocabulary, ranks), make)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n ids; only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """key, piece, start, length, ids_crc32 and, if asked for, ids: one row for each piece.  ids are the
    bytes that ids_crc32 is of, four for each id, the lowest first."""

    def cut(batches):
        import zlib

        encode = encoder(vocabulary, ranks)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = []
                for k, t in zip(batch["key"][at : at + 1000], batch["text"][at : at + 1000]):
                    ids = np.append(encode(t or ""), np.uint32(END_ID)).astype("<u4")
                    for i, (s, n) in enumerate(cuts(len(ids), capacity)):
                        own = ids[s : s + n]
                        data = own.tobytes()
                        rows.append((k, i, s, n, zlib.crc32(data), *([data] * with_ids)))
                out = pd.DataFrame(rows, columns=names)
                out["key"] = out["key"].astype("Int64")
                yield out

    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    own = picked(docs, key=docs[key].cast("long"), text=F.coalesce(docs[text], F.lit("")))
    return own.mapInPandas(tidied(cut), "key long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


# The plan -------------------------------------------------------------------------------------


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the best of the bounds that set apart the lengths over
    capacity - k, those over half, and those of at least k."""
    sizes = np.arange(capacity + 1)
    n, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    half, best = capacity // 2, -(-int(s[-1]) // capacity)
    for k in range(1, half + 1):
        big = n[-1] - n[capacity - k + 1]
        mid, mid_sum = n[capacity - k + 1] - n[half + 1], s[capacity - k + 1] - s[half + 1]
        rest = s[half + 1] - s[k]
        best = max(best, int(big + mid + max(0, -(-int(rest - (mid * capacity - mid_sum)) // capacity))))
    return best


def _floors(counts: np.ndarray) -> np.ndarray:
    """For each number the largest length that is left and not above it, or 0."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def _dominates(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the lengths of other fit into those of one as into bins (best fit)."""
    room = sorted(one)
    for x in sorted(other, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= x), None)
        if at is None:
            return False
        room[at] -= x
        room.sort()
    return True


def completions(room: int, counts: np.ndarray, limit: int) -> list[tuple[int, ...]]:
    """Undominated fillings of a room by lengths that are left, least waste first."""
    if room <= 0:
        return [()]
    floors = _floors(counts)
    found: dict[tuple[int, ...], int] = {}
    tried = 0

    def extend(left: int, top: int, chosen: tuple[int, ...]) -> bool:
        nonlocal tried
        size, width = int(floors[min(left, top)]), (64, 12, 4, 2)[min(len(chosen), 3)]
        some = False
        while size and width and tried < limit:
            if chosen.count(size) < counts[size]:
                some, width = True, width - 1
                if extend(left - size, size, (*chosen, size)):
                    return True
            size = int(floors[size - 1])
        if not some:
            tried += 1
            found[chosen] = left
            return left == 0
        return False

    extend(room, room, ())
    kept: list[tuple[int, ...]] = []
    for filling in sorted(found, key=lambda f: (found[f], len(f), [-x for x in f])):
        if len(kept) < ALTERNATIVES and not any(_dominates(k, filling) for k in kept):
            kept.append(filling)
    return kept


def _times(counts: np.ndarray, pattern: tuple[int, ...]) -> int:
    return min(int(counts[s]) // n for s, n in Counter(pattern).items())


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The incumbent: into each open sequence goes the length that fits best, again and again."""
    counts, plan = counts.copy(), []
    while counts.any():
        floors = _floors(counts)
        pattern, left, used = (int(floors[capacity]),), 0, Counter()
        left = capacity - pattern[0]
        used[pattern[0]] = 1
        size = int(floors[left])
        while size:
            if used[size] < counts[size]:
                pattern, left = (*pattern, size), left - size
                used[size] += 1
                size = int(floors[min(left, size)])
            else:
                size = int(floors[size - 1])
        times = _times(counts, pattern)
        for s, n in used.items():
            counts[s] -= n * times
        plan.append((pattern, times))
    return plan


def plan(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences): all pieces in as few sequences as found.
    counts[n] is the number of pieces of length n."""
    counts = counts.astype(np.int64)
    total, bound = int((counts * np.arange(capacity + 1)).sum()), lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    bins = sum(n for _, n in best)
    #: Each level: counts before it, waste before it, fillings not yet tried.
    stack: list[tuple[np.ndarray, int, list]] = []
    chosen: list[tuple[tuple[int, ...], int]] = []
    waste, state, spent = 0, counts.copy(), 0
    while bins > bound and spent < nodes:
        spent += 1
        allowed = (bins - 1) * capacity - total
        options = []
        if state.any():
            longest = int(np.flatnonzero(state)[-1])
            rest = state.copy()
            rest[longest] -= 1
            options = [(longest, *f) for f in completions(capacity - longest, rest, FILLINGS)]
        elif waste <= allowed:
            best, bins = list(chosen), sum(n for _, n in chosen)
            continue
        stack.append((state, waste, options))
        while stack:
            before, was, options = stack[-1]
            del chosen[len(stack) - 1 :]
            if options:
                pattern = options.pop(0)
                gap = capacity - sum(pattern)
                times = _times(before, pattern)
                if gap:
                    times = min(times, max(0, (allowed - was) // gap))
                if times:
                    state = before.copy()
                    for s, n in Counter(pattern).items():
                        state[s] -= n * times
                    waste = was + gap * times
                    chosen.append((pattern, times))
                    break
            else:
                stack.pop()
        else:
            break
    return best


def places(plan: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """One row for each length of each pattern: the ranks of that length from ``first`` on take, in
    turn, ``each`` places from ``offset`` on in the sequences from ``sequence`` on."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for size, each in Counter(pattern).items():
            rows.append((size, taken[size], sequence, each, offset))
            taken[size] += each * times
            offset += each * size
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "each", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY, order: tuple[str, ...] = ()) -> DataFrame:
    """items, which must be readable again as they are (a written table), with sequence_id, offset,
    n_sequences and least_sequences.  Ranks among equal lengths follow order, then nothing: equal rows
    are interchangeable, but all of one group; where many may be equal, order is a column that numbers
    the rows."""
    group = F.pmod(F.xxhash64(*[F.col(c) for c in order or items.columns]), F.lit(max(GROUPS, -(-items.count() // PER_GROUP))))
    own = items.withColumn("__group", group)
    counted = own.groupBy(length, "__group").agg(F.count(F.lit(1)).alias("__n"))
    # A row for each group of each length: they are joined to the pieces, never sent to all.
    counted = written(counted)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counted.groupBy(length).agg(F.sum("__n")).collect():
        counts[size] = n
    found, least = plan(counts, capacity), lower_bound(counts, capacity)
    where, used = places(found), sum(n for _, n in found)
    before = F.sum("__n").over(Window.partitionBy(length).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select(length, "__group", F.coalesce(before, F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy(length, "__group").orderBy(*(order or items.columns)))
    # Ranking has dealt the rows by these very columns, so the join moves only the counts.
    ranked = own.withColumn("__rank", rank - 1).join(starts.hint("merge"), [length, "__group"])
    ranked = ranked.select(*items.columns, (F.col("__rank") + F.col("__start")).alias("__rank"))
    keys = where["length"].to_numpy(np.int64), where["first"].to_numpy(np.int64)
    rest = {c: where[c].to_numpy(np.int64) for c in ("sequence", "each", "offset")}

    # Only lengths and ranks go to Python: what else a row holds, such as its ids, stays where it is.
    def put(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        base = int(keys[1].max()) + 1 if len(keys[1]) else 1  # lengths and ranks in one number
        n, r = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys[0] * base + keys[1], n * base + np.minimum(r, base - 1), side="right") - 1
        nth = r - keys[1][at]
        return pd.DataFrame({"sequence_id": rest["sequence"][at] + nth // rest["each"][at], "offset": rest["offset"][at] + nth % rest["each"][at] * n})

    put.__annotations__ = {"size": pd.Series, "rank": pd.Series, "return": pd.DataFrame}
    spot = F.pandas_udf(put, "sequence_id long, offset long")(F.col(length), F.col("__rank"))
    placed = ranked.withColumn("__spot", spot)
    more = F.lit(used).cast("long").alias("n_sequences"), F.lit(least).cast("long").alias("least_sequences")
    return placed.select(*items.columns, F.col("__spot.sequence_id").alias("sequence_id"), F.col("__spot.offset").alias("offset"), *more)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """key, piece, start, length, ids_crc32, ids if asked for, sequence_id, offset, n_sequences,
    least_sequences."""
    # Numbered as they are written: equal pieces of repeated rows are dealt to all groups.
    cut = written(pieces(docs, key, text, capacity, with_ids, vocabulary, ranks).withColumn("number", F.monotonically_increasing_id()))
    return pack(cut, "length", capacity, ("number",)).drop("number").withColumnRenamed("key", key)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLES: dict = {}
