"""Best-fit packing into sequences of a fixed capacity, after a Martello-Toth reduction.

Lengths are whole numbers up to the capacity, so an instance is a histogram of at most ``capacity`` counts,
whatever the number of documents: only that is solved, on the driver. First the reduction: taking the largest
length j, a set {j}, {j, k} or {j, k, b} is fixed for good where it dominates every other way to fill up j
(each alternative's items can be exchanged for items of the set that are no shorter), as many times as the
counts allow, until no rule applies; then best-fit decreasing over what is left, run by run. Each length's
items are then numbered, in buckets, and take the places that the solution has for that length; the table of
places grows with the capacity, not with the input.

Items whose length is null, below 1 or above the capacity get null places. Repeated rows are items of their
own; items of one length are alike for the packing, their order columns only say which takes which place, and
ties in them may swap. A text of any length is cut into as many pieces as it needs. Columns of the input named
as an added one (in any case) are replaced; all others may have any name. An empty table gives an empty one."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, fresh, masked, numbered, without
from tidemark.llm.tokens import encoder

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it) of one sequence


class _Left:
    """The lengths that are left, with their counts."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]

    def largest(self, most: int, used: Counter) -> int | None:
        """The largest length up to ``most`` that has an item beside the used ones."""
        at = bisect.bisect_right(self.sizes, most) - 1
        while at >= 0 and self.n[self.sizes[at]] <= used[self.sizes[at]]:
            at -= 1
        return self.sizes[at] if at >= 0 else None

    def least(self, k: int, used: Counter) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.n[s] - used[s])
            if len(out) >= k:
                break
        return out


def dominating_set(left: _Left, j: int, capacity: int) -> list[int] | None:
    """A set with ``j`` that dominates every other set with ``j``, or None where no rule proves one."""
    room, used = capacity - j, Counter([j])
    k = left.largest(room, used)
    if k is None:
        return [j]
    low = left.least(3, used)
    if k == room or len(low) < 2 or low[0] + low[1] > room:
        return [j, k]
    if len(low) < 3 or sum(low) > room:  # at most two more fit: {k, b} must dominate every pair
        b = left.largest(room - k, used + Counter([k]))
        if b is None:
            return None
        if k + b == room and b == left.largest(k, used + Counter([k])):
            return [j, k, b]
        for x in left.sizes[bisect.bisect_left(left.sizes, low[0]) : bisect.bisect_right(left.sizes, k)]:
            y = left.largest(min(x, room - x), used + Counter([x]))
            if y is not None and y > b and x + y > k:
                return None
        return [j, k, b]
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """(fixed patterns with their multiplicities, the counts left)."""
    left, fixed, again = _Left(counts), [], True
    while again:
        again = False
        for j in sorted(left.n, reverse=True):
            while left.n.get(j) and (chosen := dominating_set(left, j, capacity)):
                need = Counter(chosen)
                times = min(left.n[s] // c for s, c in need.items())
                for s, c in need.items():
                    left.take(s, c * times)
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                again = True
    return fixed, left.n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts: equal sequences are kept and filled up as one run."""
    open_runs: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if room not in open_runs:
                open_runs[room] = []
                bisect.insort(rooms, room)
            open_runs[room].append((pattern, times))

    for size in sorted(counts, reverse=True):
        count = counts[size]
        while count:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room], rooms[at]
            else:
                room, pattern, times = capacity, (), count
            each = room // size
            whole = min(times, count // each)
            put(room - each * size, (*pattern, (size, each)), whole)
            count, times = count - whole * each, times - whole
            if times and count and count < each:
                put(room - count * size, (*pattern, (size, count)), 1)
                count, times = 0, times - 1
            if pattern:
                put(room, pattern, times)
    return [run for room in rooms for run in open_runs[room]]


def solve(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: by total length, and by items above half with what cannot join them."""
    total = sum(s * c for s, c in counts.items())
    best = -(-total // capacity)
    for low in sorted({0, *(s for s in counts if 2 * s <= capacity)}):
        alone = sum(c for s, c in counts.items() if s > capacity - low)
        half = {s: c for s, c in counts.items() if capacity - low >= s > capacity / 2}
        rest = sum(s * c for s, c in counts.items() if low <= s <= capacity / 2 and s)
        room = sum((capacity - s) * c for s, c in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-(rest - room) // capacity)))
    return best


def places(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """By length: rows (first item's number, first sequence, items of it a sequence, offset of its first item)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    next_item: Counter = Counter()
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for size, each in pattern:
            out.setdefault(size, []).append((next_item[size], sequence, each, offset))
            next_item[size] += times * each
            offset += size * each
        sequence += times
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def pack(df: DataFrame, length: str, capacity: int, order: list[str]) -> DataFrame:
    """``df`` with sequence_id (from 0, gapless) and offset. ``df`` is read several times: give a written table."""
    if length in (kept := without(df.columns, ["sequence_id", "offset"])):
        inner, name = masked(df.select(*kept))
        return _pack(inner, name[length], capacity, [name[c] for c in order if c in name]).toDF(*kept, "sequence_id", "offset")
    raise ValueError(f"{length!r} can't be the length: a column of that name is added")


def _pack(df: DataFrame, length: str, capacity: int, order: list[str]) -> DataFrame:
    spark = df.sparkSession
    fits = df.where(F.col(length).between(1, capacity))
    counts = {int(r[0]): int(r[1]) for r in fits.groupBy(length).count().collect()}  # at most ``capacity`` rows
    if not counts:
        return df.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    table = spark.sparkContext.broadcast(places(solve(counts, capacity)))  # bounded by the capacity
    buckets = F.get(F.from_json(F.lit(str([-(-counts.get(s, 0) // 4096) or 1 for s in range(capacity + 1)])), "array<int>"), F.col(length).cast("int"))
    items = numbered(fits, [length], [F.col(c) for c in order or [length]], "_item", buckets=buckets)
    schema = T.StructType([*df.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in schema.fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(b.schema.get_field_index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            item = b.column(b.schema.get_field_index("_item")).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            by = np.argsort(sizes, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(sizes[by])) + 1):
                if len(part):
                    s = int(sizes[part[0]])
                    rows = table.value[s]
                    hit = rows[np.searchsorted(rows[:, 0], item[part], side="right") - 1]
                    nth = item[part] - hit[:, 0]
                    sequence[part], offset[part] = hit[:, 1] + nth // hit[:, 2], hit[:, 3] + nth % hit[:, 2] * s
            columns = [b.column(b.schema.get_field_index(c)) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names)

    out = items.select(*names[:-2], "_item").mapInArrow(place, schema)
    rest = df.where(~F.coalesce(F.col(length).between(1, capacity), F.lit(False)))
    return out.unionByName(rest.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")))


def pieces(docs: DataFrame, text: str, path: str, capacity: int, keep: list[str], end_id: int = 0) -> DataFrame:
    """``keep``, piece, start, length and ids_crc32 of each document's pieces: its ids and ``end_id``, uncut up to
    the capacity; longer ones in pieces of the capacity, the first of which has what remains."""
    keep = without(keep, ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    added = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(n, t) for n, t in added)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for b in (x.slice(at, 1000) for x in batches for at in range(0, x.num_rows, 1000)):
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(len(keep)).to_pylist()):
                ids = memoryview((encode(t) if t else b"") + end)
                n = len(ids) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (x, y) in enumerate(zip(bounds, bounds[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(ids[4 * x : 4 * y]))
            new = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in b.columns[: len(keep)]), *new], [f.name for f in schema.fields])

    return docs.select(*keep, F.col(text).alias(fresh("_text", keep))).mapInArrow(split, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, text: str = "text", keep: list[str] = ("doc_id",), end_id: int = 0) -> DataFrame:
    """Tokenize whole documents and pack their pieces into as few sequences as this method can."""
    table = cut(pieces(docs, text, path, capacity, list(keep), end_id))
    return pack(table, "length", capacity, [c for c in table.columns if c not in ("start", "length")])
