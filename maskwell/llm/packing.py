"""Best-fit packing of documents into sequences by bin completion.

Texts become token ids once, in a written table of pieces; documents over the capacity are cut
into full pieces and a rest. Pieces of equal length are interchangeable, so the search runs on
the driver over the histogram of lengths, at most ``capacity`` entries whatever the input is:
best-fit decreasing gives the first incumbent, and bin completion enumerates undominated
fillings around the largest remaining length (each runs until no piece fits, and the least waste
of the room is found by subset sums), repeats a filling while its lengths and the waste last, or
fewer times, and stops at the lower bound or after a bounded number of nodes. The plan, also bounded by the number of lengths, says for each length which
ranks go to which sequence; pieces get their rank within their length without a shuffle of one
length into one task.

Null texts are empty; an empty document is one piece, the end token. Very long texts are cut into
full pieces and a rest. Repeated rows are packed each; which of the pieces of one length goes to which
sequence is open. Other columns are not read, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import tokens
from .common import small_batches, write_table

CAPACITY, END_ID = 4096, 1
#: Nodes of the search besides three for each length, fillings kept at a node, pieces of a filling besides the largest
#: that are branched on (the room left is then filled up greedily, and once by the subset sums of all lengths).
MAX_NODES, WIDTH, DEPTH = 2000, 6, 4
#: Searches in turn, each with that number of nodes: the part of the possible repeats a filling takes at first, and
#: whether frequent lengths are preferred over large ones.
TURNS = ((1, False), (1, True))

Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences needed at least: by the sum, and by what cannot share a sequence with large pieces."""
    size = np.arange(capacity + 1)
    n, s = np.cumsum(counts), np.cumsum(counts * size)
    best, half = math.ceil(int(s[-1]) / capacity), capacity // 2
    for k in range(1, half + 1):
        over = int(n[-1] - n[capacity - k])
        mid, mid_sum = int(n[capacity - k] - n[half]), int(s[capacity - k] - s[half])
        rest = int(s[half] - s[k - 1]) - (mid * capacity - mid_sum)
        best = max(best, over + mid + max(0, math.ceil(rest / capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing, equal pieces and equal sequences at a time. The sequence that took a piece is the tightest one for
    the next of that length, so each is filled with as many as fit before another is looked at."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    mask = 0
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            above = mask >> size
            if above:
                room = size + (above & -above).bit_length() - 1
                content, n = open_[room].pop()
                if not open_[room]:
                    mask ^= 1 << room
            else:
                room, content, n = capacity, (), left
            fit = room // size
            full = min(n, left // fit)
            rest = left - full * fit if full < n else 0
            for more, times in ((fit, full), (rest, 1 if rest else 0), (0, n - full - (rest > 0) if above else 0)):
                if times:
                    open_.setdefault(room - more * size, []).append((content + (size,) * more, times))
                    mask |= 1 << (room - more * size)
            left -= full * fit + rest
    return [x for bins in open_.values() for x in bins]


def _fullest(counts: np.ndarray, mask: int, room: int, even: bool = False) -> list[tuple[int, ...]]:
    """Fillings of a room with the least waste there is, by subset sums: the one with most of the largest lengths, and the
    one with fewest. even: instead, one of each of the most frequent lengths as far as the sum allows."""
    sizes, low = [], mask & ((1 << (room + 1)) - 1)
    while low:
        sizes.append((low & -low).bit_length() - 1)
        low &= low - 1
    if even:
        sizes.sort(key=lambda x: int(counts[x]))
    whole, reach = (1 << (room + 1)) - 1, [1]
    for x in sizes:
        bits, n, k = reach[-1], min(int(counts[x]), room // x), 1
        while n:
            k = min(k, n)
            bits |= bits << k * x & whole
            n, k = n - k, 2 * k
        reach.append(bits)
    out = []
    for most in (False,) if even else (True, False):
        items, left = (), reach[-1].bit_length() - 1
        for k in range(len(sizes) - 1, -1, -1):
            x = sizes[k]
            top = min(int(counts[x]), left // x)
            tries = (1, 0, *range(2, top + 1)) if even and top else range(top, -1, -1) if most else range(top + 1)
            n = next(n for n in tries if reach[k] >> (left - n * x) & 1)
            items, left = items + (x,) * n, left - n * x
        out.append(items)
    return out


def _fillings(counts: np.ndarray, mask: int, room: int) -> list[tuple[int, ...]]:
    """Undominated fillings of a room, tightest first: no length or pair in one could give way to one larger length that also fits."""
    found: list[tuple[int, tuple[int, ...]]] = []
    tries = 0

    def largest(limit: int) -> int:
        return (mask & ((1 << (limit + 1)) - 1)).bit_length() - 1

    def free(size: int, used: tuple[int, ...]) -> bool:
        return counts[size] > used.count(size)

    def fill_up(used: tuple[int, ...], left: int, limit: int) -> tuple[tuple[int, ...], int]:
        """The largest lengths that fit, until none does."""
        size = largest(min(left, limit))
        while size > 0:
            n = min(int(counts[size]) - used.count(size), left // size)
            used, left = used + (size,) * n, left - n * size
            size = largest(min(left, size - 1))
        return used, left

    def extend(used: tuple[int, ...], left: int, limit: int) -> bool:
        """True once a filling without waste is found."""
        nonlocal tries
        size, branched = largest(min(left, limit)), 0
        while size > 0 and branched < WIDTH and tries < 8 * WIDTH:
            if free(size, used):
                tries += 1
                branched += 1
                now, rest = (*used, size), left - size
                if rest == 0:
                    found.append((0, now))
                    return True
                if len(now) == DEPTH or largest(min(rest, size)) <= 0:
                    now, rest = fill_up(now, rest, size)
                    found.append((rest, now))
                    if rest == 0:
                        return True
                elif extend(now, rest, size):
                    return True
            size = largest(size - 1)
        if branched == 0:
            found.append((left, used))
        return False

    if not extend((), room, room):
        for items in _fullest(counts, mask, room):
            found.append((room - sum(items), items))

    def dominated(slack: int, items: tuple[int, ...]) -> bool:
        for k, x in enumerate(items):
            y = largest(x + slack) if slack else x
            if y > x and free(y, items):
                return True
            for z in items[k + 1 :]:
                y = largest(x + z + slack)
                if y >= x + z and y not in items and slack:
                    return True
        return False

    best = sorted(set(found), key=lambda f: (f[0], len(f[1]), [-x for x in f[1]]))
    good = [f[1] for f in best if not f[0] or len(f[1]) > DEPTH or not dominated(*f)]
    return (good or [best[0][1]] if best else [()])[:WIDTH]


def _search(counts: np.ndarray, capacity: int, incumbent: Plan, most: int, least: int, max_nodes: int, share: int, even: bool) -> tuple[Plan, int]:
    """Bin completion from an incumbent of ``most`` sequences; a filling is repeated for a ``share``-th of what its lengths
    allow at first, so that the larger the share, the longer a mix of lengths stays."""
    total = int((counts * np.arange(capacity + 1)).sum())
    mask = sum(1 << int(k) for k in np.nonzero(counts)[0])
    path: list[list] = []  # [(filling, repeats at most) left, largest, filling taken, times]
    waste = bins = nodes = 0
    max_nodes += 3 * int((counts > 0).sum())
    while most > least and nodes < max_nodes:
        nodes += 1
        allowed = (most - 1) * capacity - total
        if mask and waste <= allowed:
            big = mask.bit_length() - 1
            counts[big] -= 1
            if not counts[big]:
                mask ^= 1 << big
            options = (_fullest(counts, mask, capacity - big, True) if even else []) + _fillings(counts, mask, capacity - big) if mask else [()]
            if not counts[big]:
                mask |= 1 << big
            counts[big] += 1
            path.append([[(items, total) for items in options], big, (), 0])
        else:
            if not mask and bins < most:
                incumbent, most = [((p[1], *p[2]), p[3]) for p in path], bins
                continue
        # the next filling of the deepest node that has one
        while path:
            node = path[-1]
            if node[3]:
                for x in (node[1], *node[2]):
                    counts[x] += node[3]
                    mask |= 1 << x
                bins -= node[3]
                waste -= node[3] * (capacity - node[1] - sum(node[2]))
                node[3] = 0
            if not node[0]:
                path.pop()
                continue
            node[2], at_most = node[0].pop(0)
            items = (node[1], *node[2])
            times = min(at_most, *(int(counts[x]) // items.count(x) for x in set(items)))
            spare = capacity - sum(items)
            if spare:
                times = min(times, (allowed - waste) // spare)
            if times < 1:
                continue
            times = -(-times // share)
            if times > 1:  # later, fewer repeats
                node[0].append((node[2], times // 2))
            node[3] = times
            for x in items:
                counts[x] -= times
                if not counts[x]:
                    mask &= ~(1 << x)
            bins += times
            waste += times * spare
            break
        else:
            break
    return incumbent, most


def plan(histogram: Iterable[tuple[int, int]], capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> Plan:
    """(lengths in a sequence, number of such sequences) for a histogram of (length, count)."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram:
        counts[size] += n
    incumbent = best_fit(counts, capacity)
    most, least = sum(n for _, n in incumbent), lower_bound(counts, capacity)
    for share, even in TURNS:
        if most > least:
            incumbent, most = _search(counts.copy(), capacity, incumbent, most, least, max_nodes, share, even)
    return incumbent


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), task, nth: the place among the task's pieces of that length."""
    kind = docs.schema["doc_id"].dataType
    fields = [("doc_id", kind), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("task", T.IntegerType()), ("nth", T.LongType())]

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        words, task = tokens.load(path), TaskContext.get().partitionId()
        end, seen, step = np.array([end_id], "<u4").tobytes(), np.zeros(capacity + 1, np.int64), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, piece, start, length, ids = [], [], [], [], []
                for k, own in enumerate(words.encode(part.column("text").to_pylist())):
                    own += end
                    for p, a in enumerate(range(0, len(own), step)):
                        row.append(k)
                        piece.append(p)
                        start.append(a // 4)
                        ids.append(own[a : a + step])
                        length.append(len(ids[-1]) // 4)
                nth = pd.Series(length).groupby(length).cumcount().to_numpy() + seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                out = [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=[f[0] for f in fields])

    return docs.select("doc_id", "text").mapInArrow(cut, T.StructType([T.StructField(n, t) for n, t in fields]))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, max_nodes: int = MAX_NODES) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    cut, _ = write_table(pieces(docs, path, capacity, end_id), "pack-pieces")
    histogram = [(r["length"], r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()]  # at most capacity rows
    sizes, first, base, copies, offset = [], [], [], [], []
    used, sequence = [0] * (capacity + 1), 0
    for items, times in plan(histogram, capacity, max_nodes):
        at = 0
        for x in sorted(set(items), reverse=True):
            n = items.count(x)
            sizes.append(x)
            first.append(used[x])
            base.append(sequence)
            copies.append(n)
            offset.append(at)
            used[x] += n * times
            at += n * x
        sequence += times
    keys = np.array(sizes, np.int64) << 44 | np.array(first, np.int64)
    order = np.argsort(keys)
    keys, first, base, copies, offset = (np.array(x, np.int64)[order] for x in (keys, first, base, copies, offset))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(keys, (length.to_numpy() << 44) | rank.to_numpy(), side="right") - 1
        away = rank.to_numpy() - first[k]
        return pd.DataFrame({"sequence_id": base[k] + away // copies[k], "offset": offset[k] + away % copies[k] * length.to_numpy()})

    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))  # two narrow columns: cheaper read again than written
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    ranked = cut.withColumn("ids_crc32", F.crc32("ids")).join(before.hint("merge"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.withColumn("at", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, doc_ids and input ids (binary) of every packed sequence."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    return rows.select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
