"""Near-duplicate vectors: sorted projection passes with verified pairs.

Each pass hashes every vector with fresh random hyperplanes, orders the vectors of a label lexicographically by
the concatenated bits, and compares each with the next ``window`` in that order. Pairs at or above the
threshold (cosine in double precision) are verified links; within a window block they are united at once, so
a pass hands on at most one edge per vector. Components are then formed over all passes' edges.

How many passes a label gets grows with its size, so that of pairs just at the threshold at most MISSES are in
no common window of any pass (``passes_for``; n ** 0.2 or so, not n). A label of up to BLOCK vectors is one block and
compared whole. Hashes are taken around the mean of large labels (of all vectors for the small ones), as a
direction that all vectors share would make most bits equal.

Links are counted exactly, by tiles of each component with itself: TILE by TILE vectors, never a whole component in a task.
This is the one step that grows with a square, that of the vectors of one component that differ from each
other, as their links themselves do. Equal vectors of a label are one class, enter the passes once and are
counted by their number.

Vectors link only within an equal, non-null label. A vector that is null, empty or zero, or holds a null or
non-finite component, links with nothing and is a component of its own, as is any without a link. Vectors of
different lengths never link. Rows that share an id are one node (a row never links with its own id); a row
with a null id has no links and a null component, and is kept. Ties in the sorted order go to the smaller
class number. An empty table gives an empty one. Only the three named columns are read, so further columns of
any name do no harm; the output has its four columns alone."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, join_small, union

BLOCK, TILE, SPREAD = 512, 2048, 10
#: The part of the pairs at the threshold that the passes may miss in a label that is larger than a block.
MISSES = 0.0005
#: Labels with more than a LARGE-th of all vectors, at most LARGE of them, have their own mean and number of passes.
LARGE = 100


def usable(vec: str):
    x = F.col(vec)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0)


def unit(rows: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in rows])
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _hash_bits(dim: int, seed: int, bits: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits))


def passes_for(n: int, threshold: float, shared: float, window: int, block: int) -> int:
    """How many passes a label of ``n`` vectors needs. Two vectors at the threshold agree in a hashed bit with
    probability p = 1 - angle / pi, the angle taken around the label's mean (``shared``: its squared length). They meet
    if they agree in as many leading bits as leave about ``window`` vectors."""
    if n <= block:
        return 1
    cosine = min(0.9999, max(0.5, (threshold - shared) / max(1e-9, 1 - shared)))
    agree = 1 - math.acos(cosine) / math.pi
    meet = agree ** math.log2(max(2.0, n / window))
    return max(2, math.ceil(math.log(MISSES) / math.log(1 - meet)))


def groups(vectors: DataFrame, threshold: float, window: int, block: int) -> dict[tuple[int | None, int], tuple[int, np.ndarray]]:
    """(passes, centre) by (label, dimension) of the large labels, and by (None, dimension) for all others together,
    which get as many passes as the greatest of them needs. The centre is the mean of the unit vectors."""
    sizes = cut(vectors.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n")))
    large = F.col("n") * LARGE > (sizes.agg(F.sum("n")).first()[0] or 0)
    own = {(r.label, r.dim): r.n for r in sizes.where(large).collect()}  # at most LARGE rows
    most = {r.dim: r.n for r in sizes.where(~large).groupBy("dim").agg(F.max("n").alias("n")).collect()}  # a row a dimension

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for dim, part in b.groupby(b["v"].map(len).to_numpy()):
                names = part["label"].to_numpy()
                apart, at = np.unique(names, return_inverse=True)
                u = unit(part["v"])
                for i, label in enumerate(apart.tolist()):
                    key = (label if (label, int(dim)) in own else None, int(dim))
                    rows = u[at == i]
                    n, total = sums.get(key, (0, 0.0))
                    sums[key] = (n + len(rows), total + rows.sum(axis=0))
        if not sums:
            return
        yield pd.DataFrame({
            "label": pd.array([k[0] for k in sums], dtype="Int64"), "dim": np.array([k[1] for k in sums], np.int32),
            "n": np.array([x[0] for x in sums.values()], np.int64), "s": [x[1].tolist() for x in sums.values()],
        })

    parts = vectors.select("label", "v").mapInPandas(add, "label long, dim int, n long, s array<double>")
    parts = parts.select("label", "dim", "n", F.posexplode("s").alias("at", "x")).groupBy("label", "dim", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    centres: dict = {}
    for r in parts.collect():  # LARGE + 1 rows by dimension and place
        centres.setdefault((r.label, r.dim), np.zeros(r.dim))[r.at] = round(r.x, 9)  # sums come in any order
    return {
        k: (passes_for(own[k] if k[0] is not None else most[k[1]], threshold, float(c @ c), window, block), c) for k, c in centres.items()
    }


def passes(vectors: DataFrame, threshold: float, n_passes: int | None, window: int, seed: int) -> DataFrame:
    """Verified edges (a, b) of the passes over ``vectors`` (rep, label, v). In a pass the sorted order is cut
    into blocks of BLOCK places, and each block also sees the first ``window`` vectors of the next one."""
    per_bits, block = 63, BLOCK
    of = groups(vectors, threshold, window, block)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(per_bits - 1, -1, -1, dtype=np.int64)
        for b in batches:
            for dim, part in b.groupby(b["v"].map(len).to_numpy()):
                rep, label, u = part["rep"].to_numpy(), part["label"].to_numpy(), unit(part["v"])
                apart, at = np.unique(label, return_inverse=True)
                plans = [of.get((x, int(dim))) or of[(None, int(dim))] for x in apart.tolist()]
                counts = np.array([n_passes or n for n, _ in plans])[at]
                u -= np.stack([c for _, c in plans])[at]
                for p in range(counts.max()):
                    rows = np.flatnonzero(counts > p)
                    signs = u[rows] @ _hash_bits(int(dim), seed + p, per_bits) > 0
                    yield pd.DataFrame({"rep": rep[rows], "grp": label[rows], "dim": np.int32(dim), "pass": np.int32(p), "code": signs.astype(np.int64) @ weights})

    coded = cut(vectors.select("rep", "label", "v").mapInPandas(keys, "rep long, grp long, dim int, pass int, code long"))
    place = numbered_in_order(coded, ["pass", "grp", "dim"], ["code", "rep"])
    home = place.withColumn("block", F.floor(F.col("at") / block)).withColumn("home", F.lit(True))
    seen = home.where((F.col("at") % block < window) & (F.col("block") > 0)).withColumns({"block": F.col("block") - 1, "home": F.lit(False)})
    rows = home.unionByName(seen).join(vectors.select("rep", "v"), "rep")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at", kind="stable")
        ids, u = part["rep"].to_numpy(), unit(part["v"])
        a, b = np.nonzero(np.triu(u @ u.T >= threshold, 1))
        root = union(np.arange(len(ids)), a, b)
        linked = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[linked], "b": ids[root[linked]]})

    edges = rows.groupBy("pass", "grp", "dim", "block").applyInPandas(compare, "a long, b long")
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def numbered_in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``at``: each row's place in its key's order, from 0. The rows are dealt by ranges of the whole order, so
    however many share a key or a code, none of their tasks is larger; each range's part of a key is contiguous
    and starts where the earlier ranges' parts end."""
    ranged = cut(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_m", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_m", 33))
    parts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    return ranged.join(parts, [*keys, "_range"]).withColumn("at", F.col("_start") + F.col("_m")).drop("_m", "_start", "_range")


def counted(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, links): by how many vectors, copies counted by their weight ``n``, each representative is linked.
    ``members``: (rep, comp, v, n) of the components with several representatives, each compared with
    itself in tiles of up to TILE by TILE, of larger components at least SPREAD by SPREAD."""
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.least(F.lit(SPREAD), F.ceil(F.count("*") / 256))).cast("int")
    sized = join_small(members, members.groupBy("comp").agg(tiles.alias("_tiles"), F.count("*").alias("c")), "comp", "c", members.count())
    tiled = sized.withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_tiles")).cast("int")).withColumn("_met", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))

    def tile(part: pd.DataFrame) -> pd.DataFrame:
        sides = [g for _, g in part.groupby("_own")]
        left, right = sides[0], sides[-1]
        out = lambda of, n: pd.DataFrame({"rep": of["rep"].to_numpy(), "links": n})
        if part["_own"].iloc[0] != part["_met"].iloc[0] and len(sides) == 1:  # the other side is empty
            return out(left, np.int64(0))
        hit = unit(left["v"]) @ unit(right["v"]).T >= threshold
        if len(sides) == 1:
            np.fill_diagonal(hit, False)
            return out(left, hit @ right["n"].to_numpy())
        return pd.concat([out(left, hit @ right["n"].to_numpy()), out(right, hit.T @ left["n"].to_numpy())])

    keys = ["comp", F.least("_own", "_met").alias("x"), F.greatest("_own", "_met").alias("y")]
    return tiled.groupBy(*keys).applyInPandas(tile, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, n_passes: int | None = None, window: int = 64, seed: int = 41) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept. ``n_passes``: the same number for all labels
    instead of what ``passes_for`` says."""
    ids = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v"))
    good = cut(ids.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v")).distinct())
    classes = good.groupBy("label", "v").agg(F.min("id").alias("rep0"), F.count("*").alias("n"))
    # an id with several vectors heads no class twice: classes get a number of their own
    classes = cut(classes.withColumn("rep", F.xxhash64("rep0", "label", "v")))
    edges = cut(passes(classes, threshold, n_passes, window, seed))
    member = good.join(classes.select("label", "v", "rep", "n"), ["label", "v"]).select("id", "rep", "n")
    member = cut(member)
    found = components(edges, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    parts = cut(classes.select("rep", "v", "n").join(found, "rep"))
    links = parts.select("rep", "comp").join(counted(parts, threshold), "rep")
    of = member.join(links, "rep", "left").select(
        "id", F.coalesce("comp", "rep").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")
    )
    of = cut(of)
    least = of.groupBy("comp").agg(F.min("id").alias("least"))
    of = of.join(least, "comp").groupBy("id", "comp", "least").agg(F.sum("links").alias("links"))
    shared = of.groupBy("id").agg(F.count("*").alias("c"), F.sum("links").alias("links"), F.min("least").alias("least"))
    many = of.join(shared.where("c > 1").select("id"), "id", "left_semi").select(F.col("least").alias("a"), "id")
    bridged = components(cut(many), "a", "id")  # ids with vectors of several components join them (rare)
    shared = shared.join(bridged, F.col("least") == F.col("node"), "left").select("id", "links", F.coalesce("component", "least").alias("least"))
    out = ids.select("id").join(shared, "id", "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "id").alias("component_id"), F.coalesce(F.coalesce("least", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
