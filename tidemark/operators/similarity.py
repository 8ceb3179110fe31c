"""Similarity of pages: tag sequences, structure hashes, SimHash, histograms, and word vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.operators.extract import TAG, all_of


def tags(html: Column) -> Column:
    return F.transform(all_of(html, TAG), F.lower)


def histogram(seq: Column) -> Column:
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(seq)), lambda t: F.struct(t, F.size(F.filter(seq, lambda x: x == t)))))


def struct_hash(seq: Column) -> Column:
    """MD5 of the number of tags and the sorted tag histogram, without the tree (``trees.signature`` has that)."""
    counts = F.transform(F.array_sort(F.array_distinct(seq)), lambda t: F.concat(t, F.lit(":"), F.size(F.filter(seq, lambda x: x == t)).cast("string")))
    return F.md5(F.concat(F.size(seq).cast("string"), F.lit("|"), F.array_join(counts, ",")))


def simhash(seq: Column) -> Column:
    """64-bit SimHash over the tags' hashes, weighted by how often they stand: a bit is set where more have it than not."""
    hashes = F.transform(seq, lambda t: F.xxhash64(t))
    bit = lambda i: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.when(F.getbit(h, i) == 1, 1).otherwise(-1)) > 0
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(bit(i), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


def hamming_similarity(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def cosine(a: Column, b: Column) -> Column:
    """Of two map<string, number> histograms."""
    dot = F.aggregate(F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0)))), F.lit(0.0), lambda s, x: s + x)
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def _lcs(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


@F.pandas_udf(DoubleType())
def sequence_similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Longest common subsequence over the longer length, of the first 200 tags (the measure is so defined)."""
    for a, b in batches:
        yield pd.Series([_lcs(list(x[:200]), list(y[:200])) / max(len(x[:200]), len(y[:200]), 1) for x, y in zip(a, b)])


def signatures(pages: DataFrame, html: str = "html") -> DataFrame:
    seq = pages.select("page_id", tags(F.col(html)).alias("tags"))
    return seq.select("page_id", "tags", struct_hash(F.col("tags")).alias("struct_hash"), simhash(F.col("tags")).alias("simhash"), histogram(F.col("tags")).alias("counts"), F.size("tags").alias("n"))


def _lcs_bits(a: list, b: list) -> int:
    """As ``_lcs``, a row at a time: bit j of ``row`` is 0 where the subsequence grows at place j of ``b``."""
    at: dict = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        u = row & at.get(x, 0)
        row = ((row + u) | (row - u)) & every
    return len(b) - row.bit_count()


def _alike(left: pd.DataFrame, right: pd.DataFrame, same: bool, threshold: float) -> pd.DataFrame:
    """(a, b, similarity) of the pairs of two shards at or above the threshold. The sequences, which are at most 1
    alike, are compared only where the other three measures leave room for that."""
    place = {t: i for i, t in enumerate(sorted({t for m in (*left["counts"], *right["counts"]) for t in dict(m)}))}

    def counts(side: pd.DataFrame) -> np.ndarray:
        m = np.zeros((len(side), len(place)))
        for i, c in enumerate(side["counts"]):
            for t, n in dict(c).items():
                m[i, place[t]] = n
        return m

    x, y = counts(left), counts(right)
    norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
    cos = np.divide(x @ y.T, norms, out=np.zeros_like(norms), where=norms > 0)
    ham = 1.0 - np.bitwise_count(left["simhash"].to_numpy().view(np.uint64)[:, None] ^ right["simhash"].to_numpy().view(np.uint64)[None, :]) / 64.0
    n, m = left["n"].to_numpy(float)[:, None], right["n"].to_numpy(float)[None, :]
    size = np.divide(np.minimum(n, m), np.maximum(n, m), out=np.full(norms.shape, np.nan), where=np.maximum(n, m) > 0)
    room = 1.0 + ham + size + cos >= 4 * threshold - 1e-5  # what is rounded to the threshold counts
    if same:
        room &= left["page_id"].to_numpy()[:, None] < right["page_id"].to_numpy()[None, :]
    ids, others, l_tags, r_tags = left["page_id"].to_numpy(), right["page_id"].to_numpy(), [list(t[:200]) for t in left["tags"]], [list(t[:200]) for t in right["tags"]]
    out = []
    for i, j in zip(*np.nonzero(room)):
        seq = _lcs_bits(l_tags[i], r_tags[j]) / max(len(l_tags[i]), len(r_tags[j]), 1)
        if (score := (seq + ham[i, j] + size[i, j] + cos[i, j]) / 4) >= threshold - 1e-6:
            out.append((min(ids[i], others[j]), max(ids[i], others[j]), score))
    return pd.DataFrame(out, columns=["a", "b", "similarity"])


def similar_structures(signed: DataFrame, threshold: float = 0.85, shard: int = 512) -> DataFrame:
    """Pairs (a < b) of distinct structures with a composite similarity of at least ``threshold``: the mean of tag
    sequence, SimHash, size and histogram similarity. Equal structures are one representative each; these are dealt
    into shards of bounded size and every two shards meet in a tile, so every pair is compared."""
    reps = signed.groupBy("struct_hash").agg(F.min_by(F.struct("page_id", "tags", "simhash", "counts", "n"), "page_id").alias("r")).select("r.*")
    n = signed.select("struct_hash").distinct().count()
    shards = max(1, -(-n // shard), min(10, n // 16))
    own = F.pmod(F.xxhash64("page_id"), F.lit(shards)).cast("int")
    tiled = reps.select("page_id", "tags", "simhash", F.map_entries("counts").alias("counts"), "n", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("met"))

    def tile(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part["counts"] = [[tuple(e.values()) if isinstance(e, dict) else tuple(e) for e in c] for c in part["counts"]]
        left, right = part[part["own"] == key[0]], part[part["own"] == key[1]]
        return _alike(left, right, key[0] == key[1], threshold)

    pairs = tiled.groupBy(F.least("own", "met").alias("x"), F.greatest("own", "met").alias("y")).applyInPandas(tile, "a long, b long, similarity double")
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity")).where(F.col("similarity") >= threshold)


def words(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, word, tf): lower-cased words without punctuation at their ends."""
    w = F.transform(F.split(F.lower(F.col(text)), r"\s+"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\p{Punct}]+", ""), r"[\p{Punct}]+$", ""))
    return df.select(F.col(id_col).alias("id"), F.explode(w).alias("word")).where("word <> ''").groupBy("id", "word").agg(F.count("*").alias("tf"))


def text_cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cosine of word counts for every pair that shares a word; both sides are (id, word, tf)."""
    norm = lambda d, n: d.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias(n))
    dot = left.select(F.col("id").alias("a"), "word", F.col("tf").alias("x")).join(right.select(F.col("id").alias("b"), "word", F.col("tf").alias("y")), "word").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    out = dot.join(norm(left, "na"), F.col("a") == F.col("id")).drop("id").join(norm(right, "nb"), F.col("b") == F.col("id")).drop("id")
    return out.select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine"))
