"""Near-duplicate texts: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets.

A text's words (A-Z lower-cased, cut at ASCII white space) give its set of ``width``-word shingles, fewer words
one shingle. A signature holds HASHES minima of 16 bits. It is split into CHUNKS chunks; two signatures that
differ in at most ``HASHES // (HASHES // CHUNKS) * 2 - 1`` = 15 of 32 places have, by pigeonhole, a chunk with at
most one difference, so with every chunk's one-place wild cards as keys all such pairs meet in a bucket. (Of
pairs with a similarity of 0.75, 0.2 % differ in more places; of more similar pairs, fewer.) Equal sets are one
class throughout. The distance is made for similarities of 75 percent and more; lower ones are refused.

Buckets are compared in tiles of bounded size, whatever a bucket's size. First every class takes the smallest
class that it meets within the signature distance; these pairs are confirmed on full sets and united. Then what
met and is still in different components forms families, whose members are compared in tiles on full sets; those
of a family's largest component meet only the others. So a group of n near copies costs about n confirmations and
n times its stragglers, no pairs are listed, and none that could join two components is left out.

Texts that are null, empty or blank have an empty set and link with nothing. Texts of any length count whole; a
long one is held by one task at a time. Of equal sets the smallest id stands for all. Rows with a null id have no
component and are kept. Rows that share an id are one node. An empty table gives an empty one. Only the id and the
text are read, so further columns of any name do no harm; the output has its four columns alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import components, cut, give_back, join_small, settle, union, whole_runs
from tidemark.llm.mixing import _mix64
from tidemark.llm.tokens import _Kept

HASHES, CHUNKS = 32, 8
ROWS = HASHES // CHUNKS
DISTANCE = 2 * CHUNKS - 1
TILE, FAMILY_TILE = 2048, 512

_rng = np.random.default_rng(2_718_281)
_FACTORS = _rng.integers(0, 2**64, HASHES, dtype=np.uint64, endpoint=False) | np.uint64(1)
_SHIFTS = _rng.integers(0, 2**64, HASHES, dtype=np.uint64, endpoint=False)
_PLACES = _rng.integers(0, 2**64, 64, dtype=np.uint64, endpoint=False) | np.uint64(1)

_words = _Kept(xxhash.xxh3_64_intdigest, 100_000)


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(w))
    with np.errstate(over="ignore"):
        total = np.full(len(w) - width + 1, np.uint64(width))
        for j in range(width):
            total += w[j : len(w) - width + 1 + j] * _PLACES[j]
    return np.unique(_mix64(total))


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether 100 * intersection >= percent * union, of two sorted distinct arrays (empty ones never)."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, id_col: str, text: str, width: int = 5) -> DataFrame:
    """(id, n_shingles, set: 16 bytes that stand for the whole set, or null if empty, sig: HASHES 16-bit minima)."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def sign(ids, sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], np.int64)
        sig = np.zeros((len(sets), HASHES), np.uint64)
        full = np.flatnonzero(n)
        if len(full):
            every = np.concatenate(sets)
            starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            with np.errstate(over="ignore"):
                for i in range(HASHES):
                    sig[full, i] = np.minimum.reduceat(every * _FACTORS[i] + _SHIFTS[i], starts)
            sig = _mix64(sig)
        packed = sig.astype("<u2")
        marks = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(marks, pa.binary()), pa.array([r.tobytes() if k else None for r, k in zip(packed, n)], pa.binary())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 1000) for x in batches for at in range(0, x.num_rows, 1000)):
            sets: list[np.ndarray] = []
            begin = held = 0
            for i, t in enumerate(b.column(1).to_pylist()):
                sets.append(shingle_hashes(t, width))
                held += len(sets[-1])
                if held > 1_000_000:  # long texts: sign what is there
                    yield sign(b.column(0).slice(begin, len(sets)), sets)
                    begin, held, sets = i + 1, 0, []
            if sets:
                yield sign(b.column(0).slice(begin, len(sets)), sets)
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def buckets(classes: DataFrame) -> DataFrame:
    """(key, cls, n, low): each class under the key of each chunk with each place of it left open. ``low`` holds
    the low bytes of the signature: a distance over them is never above the true one."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("n", T.LongType()), T.StructField("low", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u2").reshape(-1, HASHES)
            low = pa.array([x.tobytes() for x in (sig & 255).astype(np.uint8)], pa.binary())
            for c in range(CHUNKS):
                part = sig[:, c * ROWS : (c + 1) * ROWS].astype(np.int64)
                for open_place in range(ROWS):
                    key = np.full(len(sig), c * ROWS + open_place, np.int64)
                    for j in range(ROWS):
                        if j != open_place:
                            key = key << 16 | part[:, j]
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), b.column(1), low], schema.names)

    return classes.select("cls", "n", "sig").mapInArrow(run, schema)


def tiles(rows: DataFrame) -> DataFrame:
    """The rows of buckets with several classes, dealt into tiles (key, x, y): side 0 is part x of the bucket,
    side 1 part y; only x <= y."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    met = rows.join(sizes, "key").withColumn("parts", F.ceil(F.col("c") / TILE).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), "cls", "n", "low")


def _pairs(group: np.ndarray, side: np.ndarray, sizes: np.ndarray, low: np.ndarray, differ: np.ndarray | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of one tile within the distance; tiles are the runs of ``group``. Those of a few rows are
    compared all at once by their distance in the run, larger ones each by itself."""

    def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = 100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])
        if differ is not None:
            ok &= differ[i] != differ[j]
        i, j = i[ok], j[ok]
        ok = (low[i] != low[j]).sum(axis=1) <= DISTANCE
        return i[ok], j[ok]

    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.append(starts[1:], len(group))
    long = np.repeat(ends - starts > 12, ends - starts)
    for step in range(1, 12):
        i = np.flatnonzero((group[:-step] == group[step:]) & ~long[:-step]) if step < len(group) else np.zeros(0, np.int64)
        if len(i):
            keep = ~((side[i] == side[i + step]) & crossed(group, side, starts, ends)[i])
            yield near(i[keep], i[keep] + step)
    for a, b in zip(starts, ends):
        if b - a <= 12:
            continue
        if differ is not None and (differ[a:b] == differ[a]).all():
            continue
        left = np.arange(a, b)[side[a:b] == 0]
        right = np.arange(a, b)[side[a:b] == 1]
        for at in range(0, len(left), 64):
            i = left[at : at + 64]
            j = right if len(right) else left
            ii, jj = np.repeat(i, len(j)), np.tile(j, len(i))
            if not len(right):
                ii, jj = ii[ii < jj], jj[ii < jj]
            yield near(ii, jj)


def crossed(group: np.ndarray, side: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a row's tile has two sides (then rows of one side are not compared in it)."""
    two = np.maximum.reduceat(side, starts) > 0
    return np.repeat(two, ends - starts)


def meet(tiled: DataFrame, apart: bool, percent: int = 75) -> DataFrame:
    """Pairs (a >= b) of classes that meet in a tile within the signature distance: of each class a that meets
    any, only that with the smallest b it meets, itself included; or, ``apart``, edges (a > b) that connect what
    meets across components (column comp), at most one for each row of a tile."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    keys = ["key", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, keys):
            column = {c: t.column(c).to_numpy() for c in t.column_names if c != "low"}
            low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(-1, HASHES)
            new = np.concatenate([[True], np.any([column[k][1:] != column[k][:-1] for k in keys], axis=0)])
            cls, found = column["cls"], []
            for i, j in _pairs(np.cumsum(new), column["side"], column["n"], low, column.get("comp"), percent):
                if len(i):
                    found.append((i, j))
            if not found:
                continue
            i, j = (np.concatenate(x) for x in zip(*found))
            if apart:
                root = union(np.arange(len(cls)), i, j)
                i = np.flatnonzero(root != np.arange(len(cls)))
                j = root[i]
            a, b = np.maximum(cls[i], cls[j]), np.minimum(cls[i], cls[j])
            if not apart:
                a, b = np.concatenate([a, b]), np.concatenate([b, b])
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.concatenate([[True], a[1:] != a[:-1]]) | (np.concatenate([[True], b[1:] != b[:-1]]) if apart else False)
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], schema.names)

    dealt = tiled.repartition(*keys).sortWithinPartitions(*keys)
    pairs = dealt.mapInArrow(run, schema)
    return pairs.where("a <> b").distinct() if apart else pairs.groupBy("a").agg(F.min("b").alias("b"))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, hashes: the sorted shingle hashes as bytes) of (id, text), so that no comparison hashes a text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 200) for x in batches for at in range(0, x.num_rows, 200)):
            sets = pa.array([shingle_hashes(t, width).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["id", "hashes"])
        give_back()

    return texts.select("id", "text").mapInArrow(run, "id long, hashes binary")


def confirm_families(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components within families: ``members`` are (fam, cls, comp, low, hashes). The
    members are compared in tiles of FAMILY_TILE by FAMILY_TILE, those within the signature distance on their full
    sets; of a tile's links only those that unite its components are returned. The members of a family's largest
    component are known to be connected: they meet the others only, which costs copies in proportion to both."""
    of = members.groupBy("fam", "comp").agg(F.count("*").alias("n"))
    of = of.groupBy("fam").agg(F.sum("n").alias("c"), F.max(F.struct("n", "comp")).alias("main"))
    parts = lambda n: F.ceil(n / FAMILY_TILE).cast("int")
    of = of.select("fam", "c", F.col("main.comp").alias("main"), parts(F.col("main.n")).alias("a"), parts(F.col("c") - F.col("main.n")).alias("b"))
    sized = join_small(members, of.where("b > 0"), "fam", "c", members.count())
    inside = F.col("comp") == F.col("main")
    sized = sized.withColumn("part", F.when(inside, F.pmod(F.xxhash64("cls"), F.col("a"))).otherwise(F.col("a") + F.pmod(F.xxhash64("cls"), F.col("b"))).cast("int"))
    sized = sized.withColumn("other", F.explode(F.sequence(F.when(inside, F.col("a")).otherwise(0), F.col("a") + F.col("b") - 1)))
    rows = sized.select("fam", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), "cls", "comp", "low", "hashes")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    keys = ["fam", "x", "y"]

    def links(cls: np.ndarray, comp: np.ndarray, side: np.ndarray, low: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        parent, out = {c: c for c in comp.tolist()}, []

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        n = np.array([len(s) for s in sets], np.int64)
        two, at = bool(side.any()), np.arange(len(cls))
        for i in np.flatnonzero(side == 0) if two else at:
            others = at[side == 1] if two else at[i + 1 :]
            others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
            others = others[(low[others] != low[i]).sum(axis=1) <= DISTANCE]
            own = root(int(comp[i]))
            others = others[[root(int(c)) != own for c in comp[others]]] if len(others) else others
            if not len(others) or not n[i]:
                continue
            every = np.concatenate([sets[j] for j in others])
            place = np.minimum(np.searchsorted(sets[i], every), n[i] - 1)
            both = np.add.reduceat((sets[i][place] == every).astype(np.int64), np.cumsum(np.concatenate([[0], n[others][:-1]])))
            for j in others[100 * both >= percent * (n[i] + n[others] - both)]:
                p, q = root(int(comp[i])), root(int(comp[j]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((int(max(cls[i], cls[j])), int(min(cls[i], cls[j]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, keys):
            new = np.concatenate([[True], np.any([t.column(k).to_numpy()[1:] != t.column(k).to_numpy()[:-1] for k in keys], axis=0)])
            cls, comp, side = (t.column(c).to_numpy() for c in ("cls", "comp", "side"))
            low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(-1, HASHES)
            starts, found = np.flatnonzero(new), []
            for a, b in zip(starts, np.append(starts[1:], len(cls))):
                sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").slice(a, b - a).to_pylist()]
                found += links(cls[a:b], comp[a:b], side[a:b], low[a:b], sets)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, per_group: int = 64) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``sets``: (id, hashes) of all their classes. Each b
    meets its partners in groups of about ``per_group``."""
    sized = pairs.groupBy("b").agg(F.ceil(F.count("*") / per_group).cast("int").alias("parts"))
    dealt = pairs.join(sized, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    wanted = dealt.select(F.col("a").alias("id"), "b", "part").unionByName(
        sized.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    )
    rows = sets.join(wanted, "id").select("b", "part", "id", "hashes")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, ["b", "part"]):
            hub, part, ids, hashes = (t.column(c) for c in ("b", "part", "id", "hashes"))
            a, b, at, heads = [], [], None, []
            for h, p, i, x in zip(hub.to_pylist(), part.to_pylist(), ids.to_pylist(), hashes.to_pylist()):
                if at != (h, p):
                    at, heads = (h, p), []
                s = np.frombuffer(x, np.uint64)
                if i == h:  # sorted: the head's texts stand first
                    heads.append(s)
                elif any(linked(y, s, percent) for y in heads):
                    a.append(i)
                    b.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema.names)

    order = ["b", "part", F.col("id") != F.col("b"), "id"]
    return rows.repartition("b", "part").sortWithinPartitions(*order).mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept (one row of a component's smallest id is
    kept per row that has this id)."""
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100: the signatures' distance loses pairs of a lower similarity")
    signed = cut(signatures(docs, id_col, text, width))
    real = signed.where("id is not null and set is not null")
    classes = cut(real.groupBy("set").agg(F.min(F.struct("id", "sig", "n_shingles")).alias("m")).select("set", F.col("m.id").alias("cls"), F.col("m.n_shingles").alias("n"), F.col("m.sig").alias("sig")))
    tiled = cut(tiles(buckets(classes)))
    met = cut(meet(tiled, False, percent))
    first, wanted = met.where("a <> b"), met.select(F.col("a").alias("id"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")
    sets = cut(shingle_sets(texts, width))
    links = cut(confirm(first, sets, percent))
    heads = classes.select(F.col("cls").alias("id"), "cls").distinct()
    comp = cut(settle(heads, links))
    labelled = tiled.join(comp.select(F.col("id").alias("cls"), F.col("component").alias("comp")), "cls").join(wanted.select(F.col("id").alias("cls")), "cls", "left_semi")
    families = components(meet(labelled, True, percent), "a", "b").select(F.col("node").alias("cls"), F.col("component").alias("fam"))
    lows = tiled.join(families, "cls").groupBy("fam", "cls").agg(F.min("low").alias("low"))
    members = cut(lows.join(comp.select(F.col("id").alias("cls"), F.col("component").alias("comp")), "cls"))
    members = cut(members.join(sets.withColumnRenamed("id", "cls"), "cls"))
    more = cut(confirm_families(members, percent))
    member = real.select("id", "set").distinct().join(classes.select("set", "cls"), "set").select("id", "cls")
    out = settle(cut(member), links.unionAll(more))
    return signed.select("id", "n_shingles").join(out, "id", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
