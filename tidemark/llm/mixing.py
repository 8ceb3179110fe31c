"""Mixing sources to target weights over fixed-length blocks.

Each source's words form one stream (its documents in a hashed order), cut into blocks of ``block`` words. The
output is a row of slots: slot j of a source holds the block at place j of that source's pseudorandom
permutation (a new permutation for every further pass over the source). Slots are dealt to output shards by
multinomial draws under the fixed totals of the sources, that is, multivariate hypergeometric ones: a tree of
shards is descended from the root, and each node draws how many of its slots of each source go left. Blocks and
slots meet in a join by (source, block index). The last slot of a source is cut to its remaining words, so a
source gives exactly floor(target) words.

A null source is a source of its own and sorts last. Null, empty and blank texts have size 0 and are never
taken; a source of size 0 has target 0. A text of any length is cut into as many blocks as it needs. Repeated rows
are documents of their own; rows that are equal in the order columns and in size are alike for the mix and may
swap places. An empty table gives an empty one. Columns of the input that have a name of an output column are
replaced by it; all others may have any name. The table of sources (one row each) is ordered as a whole: it is a
dimension, not the corpus, and more than MAX_SOURCES sources raise an error."""

from __future__ import annotations

from collections.abc import Iterator
from math import e, floor, lgamma, sqrt
from math import log as ln

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, masked, numbered, without

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256
MAX_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Words of a text (null: 0), without building them: places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, weight, source_size, target.

    ``weights`` repeat over the sources by code point, null last. The targets share ``share`` times all sizes by
    weight; one stops at ``most`` times its source's size and the excess is reshared until none is above. That
    is one water level: sources are full in the order of size / weight, and the level is found by running sums."""
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    by_code = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.lit([float(x) for x in weights])
    per = per.withColumn("weight", F.get(w, F.pmod(F.row_number().over(by_code) - 1, F.lit(len(weights)))))
    cap = F.col("source_size") * F.lit(float(most))
    full = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").isNull(), F.encode("source", "utf-8")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumns({
        "_cap": cap,
        "_left": F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(full), F.lit(0.0)),
        "_weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0.0)),
    })
    # the level if this source and all after it were the ones that aren't full; the first that holds (the greatest) is the level
    per = per.withColumn("_level", F.col("_left") / F.col("_weights"))
    per = per.withColumn("_level", F.max(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))).over(every))
    return per.select(
        "source", "weight", "source_size",
        F.least(F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")), F.col("_cap")).cast("double").alias("target"),
    )


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of each ``index`` under a pseudorandom permutation of [0, n) chosen by ``key``: a four-round
    Feistel network on the least even number of bits that holds n, walked on until the image is below n."""
    index, n, key = (np.asarray(x).astype(np.uint64) for x in (index, n, key))
    half = np.ceil(np.log2(np.maximum(n.astype(float), 2.0) + 1e-9) / 2).astype(np.uint64) + np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, live = index.copy(), np.ones(len(index), bool)
    while live.any():
        x, h, m, k = out[live], half[live], mask[live], key[live]
        left, right = x >> h, x & m
        with np.errstate(over="ignore"):
            for r in range(4):
                left, right = right, left ^ (_mix64(right + k + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % 2**64)) & m)
        out[live] = (left << h) | right
        live[live] = out[live] >= n[live]
    return out.astype(np.int64)


def shard_counts(totals: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, slots of each source in it), by descending the tree of draws."""
    before, own, low, high = np.zeros_like(totals), totals.copy(), 0, shards
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        go = own.sum() * (mid - low) // (high - low)
        left = _draw(rng, own, int(go))
        if shard < mid:
            own, high = left, mid
        else:
            before, own, low = before + left, own - left, mid
    return before, own


def _draw(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw of n, colour by colour."""
    out, rest = np.zeros_like(colours), int(colours.sum())
    if rest < 10**9:  # what numpy's generator takes
        return rng.multivariate_hypergeometric(colours, n, method="marginals")
    for i, c in enumerate(colours.tolist()):
        rest -= c
        out[i] = hypergeometric(rng, c, rest, n)
        n -= int(out[i])
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are of the ``good``, for any counts: by the ratio of uniforms, under
    a hat that fits every log-concave distribution."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n and good else 0
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    log = lambda k: -(lgamma(k + 1) + lgamma(good - k + 1) + lgamma(n - k + 1) + lgamma(bad - n + k + 1))
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    share = good / (good + bad)
    spread = n * share * (1 - share) * (good + bad - n) / (good + bad - 1)
    width = 2 * sqrt(2 / e) * sqrt(spread + 0.5) + 3 - 2 * sqrt(3 / e)
    while True:
        u, v = 1 - rng.random(), rng.random() - 0.5
        k = floor(n * share + 0.5 + width * v / u)
        if low <= k <= high and 2 * ln(u) <= log(k) - log(mode):
            return k


def plan(goals: DataFrame, block: int, per_shard: int, seed: int) -> tuple[DataFrame, int]:
    """The slots: (sid, block index, epoch, shard, place in the shard, words of the block that it takes), and the
    number of shards. ``goals``: (sid from 0 without gaps, source_size, target)."""
    spark = goals.sparkSession
    if goals.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = goals.select("sid", "source_size", "target").orderBy("sid").collect()  # one row per source
    size = np.array([r.source_size for r in rows], np.int64)
    want = np.array([int(r.target) for r in rows], np.int64)
    blocks = -(-size // block)
    short = size - (blocks - 1) * block  # words of each source's last block
    epochs = np.where(size > 0, want // np.maximum(size, 1), 0)
    rest = want - epochs * size
    # in the last pass the short block may come early: then one slot more may be needed
    slots = epochs * blocks + -(-rest // block)
    key = _mix64(np.arange(len(rows), dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(seed)) >> np.uint64(2)
    for s in np.flatnonzero(rest):
        part = int(slots[s] - epochs[s] * blocks[s])
        early = _place(int(blocks[s]), key[s] + np.uint64(epochs[s])) < part
        if early and part * block - (block - int(short[s])) < rest[s]:
            slots[s] += 1
    total = int(slots.sum())
    shards = max(1, -(-total // per_shard))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                before, own = shard_counts(slots, shards, int(shard), seed)
                n = int(own.sum())
                sid = np.repeat(np.arange(len(own)), own)
                slot = np.concatenate([np.arange(x, x + y) for x, y in zip(before, own)]) if n else np.zeros(0, np.int64)
                epoch = slot // np.maximum(blocks[sid], 1)
                inside = slot - epoch * blocks[sid]
                index = permuted(inside, blocks[sid], key[sid] + epoch.astype(np.uint64))
                words = np.where(index == blocks[sid] - 1, short[sid], block)
                last = slot == slots[sid] - 1
                for i in np.flatnonzero(last & (rest[sid] > 0)):
                    s = sid[i]  # what the earlier slots of the last pass took, in full blocks but for the short one
                    done = int(inside[i]) * block
                    spot = _place(int(blocks[s]), key[s] + np.uint64(epochs[s]))
                    done -= (block - int(short[s])) if spot < inside[i] else 0
                    words[i] = int(rest[s]) - done
                place = np.random.default_rng([seed, 7, int(shard)]).permutation(n)
                yield pd.DataFrame({"sid": sid.astype(np.int32), "block": index, "epoch": epoch, "shard": np.full(n, shard), "place": place, "words": words})

    grid = spark.range(0, shards, 1, -(-shards // 16))
    return grid.mapInPandas(draw, "sid int, block long, epoch long, shard long, place long, words long"), shards


def _place(n: int, key: np.uint64) -> int:
    """Where the permutation has the last index: the inverse of its Feistel network, walked the same way."""
    half = int(np.ceil(np.log2(max(float(n), 2.0) + 1e-9) / 2)) + 1
    mask, x = (1 << half) - 1, n - 1
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(4)):
            k = (left + int(key) + 0x9E3779B97F4A7C15 * (r + 1)) % 2**64
            left, right = right ^ (int(_mix64(np.array([k], np.uint64))[0]) & mask), left
        x = (left << half) | right
        if x < n:
            return x


def mix(docs: DataFrame, source: str = "source", size: str = "size", order: list[str] = ("doc_id",), carry: list[str] = (), weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, per_shard: int = 1024, seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): every document once, with ``carry``, row (its number), size, source_size and target;
    and the taken spans (row, epoch, shard, place, offset: words of the slot before it, start: word of the
    document, length), which are the mix itself in the order of (shard, place, offset).

    Columns ``order`` and ``carry`` of one of these names are replaced. ``docs`` is written once to the shared
    folder, so keep its columns narrow."""
    named = without(list(dict.fromkeys([*order, *carry])), ["sid", "row", "size", "source_size", "target", "taken"])
    inner = {c: f"_c{i}" for i, c in enumerate(dict.fromkeys([*order, *carry]))}
    narrow = docs.select(*[F.col(c).alias(x) for c, x in inner.items()], F.col(source).alias("_source"), F.col(size).alias("_size"))
    narrow = cut(narrow)
    goals = cut(targets(narrow, "_source", "_size", weights, share, most).withColumn(
        "sid", (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))) - 1).cast("int")))
    of = goals.select(F.col("source").alias("_goal"), "source_size", "target", "sid")
    keyed = narrow.join(of, F.col("_source").eqNullSafe(F.col("_goal")), "left").drop("_source", "_goal")
    placed = numbered(cut(keyed), ["sid"], [F.col(inner[x]) for x in order] + [F.col("_size")], "nth")
    # the running sum of sizes within a source, by the same buckets as the numbers: 4,096 rows each
    placed = cut(placed.withColumns({"_bin": F.floor(F.col("nth") / 4096)}))
    bins = placed.groupBy("sid", "_bin").agg(F.sum("_size").alias("_n"))
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("sid").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("sid", "_bin").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    at = at.join(bins.drop("_n"), ["sid", "_bin"]).withColumn("_at", F.col("_before") + F.col("_in")).drop("_before", "_in", "_bin")
    documents = at.withColumnRenamed("nth", "row")
    pieces = documents.where("_size > 0").select(
        "sid", "row", "_at", "_size",
        F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("_size") - 1) / block))).alias("block"),
    )
    begin, end = F.greatest(F.col("block") * block, F.col("_at")), F.least((F.col("block") + 1) * block, F.col("_at") + F.col("_size"))
    pieces = pieces.select("sid", "block", "row", (begin - F.col("_at")).alias("start"), (end - begin).alias("length"), (begin - F.col("block") * block).alias("offset"))
    slots, _ = plan(goals, block, per_shard, seed)
    spans = (
        pieces.join(slots.hint("merge"), ["sid", "block"])  # both sides grow with the input
        .withColumn("length", F.least(F.col("length"), F.col("words") - F.col("offset"))).where("length > 0")
        .select("sid", "row", "epoch", "shard", "place", "offset", "start", "length")
    )
    return documents.select(*[F.col(inner[c]).alias(c) for c in named], "sid", "row", F.col("_size").alias("size"), "source_size", "target"), spans


def taken(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``documents`` with taken: the words of each that the mix takes, repeats counted."""
    per = spans.groupBy("sid", "row").agg(F.sum("length").alias("taken"))
    return documents.join(per, ["sid", "row"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """The mix as documents: one row per document and pass over its source, with the words that the pass takes.
    A text that is taken whole stays as it is; of others the taken words follow each other with single blanks.
    The columns of ``docs``, of any names, are kept with their own row's values, ``n_chars`` is counted again. Repeated rows are taken as
    often as they stand."""
    inner, name = masked(docs)
    text_, rest = name[text], [c for c in inner.columns if c != name[text]]
    # a row is known by its id, source, text and all else that it has; rows that are equal in all may stand for each other
    same = [name[doc_id], name[source], "_crc", "_rest"]
    keyed = inner.withColumns({"_crc": F.crc32(F.coalesce(text_, F.lit(""))), "_rest": F.xxhash64(text_, F.to_json(F.struct(*rest)))})
    documents, spans = mix(keyed.select(*same, n_words(F.col(text_)).alias("_words")), name[source], "_words", order=[name[doc_id], "_crc", "_rest"], carry=[name[source]], **options)
    takes = spans.groupBy("sid", "row", "epoch").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("_spans"))  # of one document
    takes = takes.join(documents.select("sid", "row", "size", *same), ["sid", "row"])
    takes = takes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(same)], F.col("size").alias("_size"), "_spans")
    on = None
    for i, c in enumerate(same):
        x = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        on = x if on is None else on & x
    rows = keyed.dropDuplicates(same).join(takes, on)
    words = F.regexp_extract_all(F.col(text_), F.lit(WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice("_all", (s["start"] + 1).cast("int"), s["length"].cast("int")))), " ")
    whole = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]) == F.col("_size")
    rows = rows.withColumn("_all", F.when(~whole, words)).withColumn(text_, F.when(whole, F.col(text_)).otherwise(some))
    if n_chars in docs.columns:
        rows = rows.withColumn(name[n_chars], F.length(text_).cast(docs.schema[n_chars].dataType))
    return rows.select(*inner.columns).toDF(*docs.columns)
