"""Exact top-k search by inner product, over tiles of queries and shards.

Queries are dealt into blocks and candidates into shards, both of bounded size; a tile is one block against
one shard. Each tile is one matrix product followed by a partial selection of k candidates for each query; the
tiles' lists then meet in a tree of merges (FAN_IN lists a step), so that no task ever holds all candidates of
a query. Every row enters the tiles, so the result is exact.

Scores are integers: components become floor(scale * x), held as doubles, which is exact for every finite x (a
product beyond the doubles counts as the greatest one). Scores are computed in double precision where that is
exact (bounded by 2**53) and in Python integers otherwise. A score beyond a long is returned as the nearest long;
its rank is still that of the whole score. A vector that is null, empty, or holds a null or non-finite component
takes no part, nor does a row with a null id; only vectors of the query's own length are its candidates. Fully
repeated rows count once; a candidate with the query's own id is never returned. Ties go to the smaller id. An
empty table gives an empty one. Only the id and the vector are read, so further columns do no harm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

FAN_IN = 16
QUERY_BLOCK, SHARD = 4096, 8192


def to_integers(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, v array<double> of whole numbers) of the usable rows."""
    greatest = F.lit(float(np.finfo(float).max))
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= greatest))

    def whole(x: Column) -> Column:
        y = F.least(F.greatest(x.cast("double") * F.lit(float(scale)), -greatest), greatest)
        return F.when(F.abs(y) < float(2**53), F.floor(y).cast("double")).otherwise(y)  # from 2**53 on all are whole

    return (
        df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & fine)
        .select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, whole).alias("v")).distinct()
    )


LONG = 2**63 - 1


def _beyond(score: int) -> str:
    """What orders scores that are beyond a long among themselves, as text; empty for others."""
    return "" if -LONG - 1 <= score <= LONG else f"{score + 2**2200:0560x}"


def top_of_tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """The k best candidates of each query: (query ids, candidate ids, scores, ``_beyond``), a few queries at a time."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    with np.errstate(over="ignore"):
        bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    exact = bound < 2**53
    in_full = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    right = c.astype(float).T.copy() if exact else in_full(c).T
    n = len(c_ids)
    for at in range(0, len(q_ids), step):
        ids = q_ids[at : at + step]
        s = q[at : at + step].astype(float) @ right if exact else in_full(q[at : at + step]) @ right
        own = c_ids[None, :] == ids[:, None]
        if exact and bound < 2**62 / (2 * n + 2):
            rank = s.astype(np.int64) * n + (n - 1 - np.arange(n))[None, :]  # unique: ties go to the smaller id
            rank[own] = np.iinfo(np.int64).min + 1
            m = min(k, n)
            best = np.argpartition(-rank, m - 1, axis=1)[:, :m] if m < n else np.tile(np.arange(n), (len(ids), 1))
            take = ~np.take_along_axis(own, best, axis=1)
            rows = np.broadcast_to(np.arange(len(ids))[:, None], best.shape)[take]
            cols = best[take]
            yield ids[rows], c_ids[cols], s[rows, cols].astype(np.int64), [""] * len(cols)
        else:
            for i, qid in enumerate(ids):
                cols = sorted((j for j in range(n) if not own[i, j]), key=lambda j: (-int(s[i, j]), j))[:k]
                full = [int(s[i, j]) for j in cols]
                yield np.full(len(cols), qid), c_ids[cols], np.array([min(LONG, max(-LONG - 1, x)) for x in full], np.int64), [_beyond(x) for x in full]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query's k best candidates. Both sides: (id, v: an array of
    whole numbers); they are written once to the shared folder."""
    if k < 1:
        raise ValueError("k must be at least 1")
    queries, candidates = cut(queries), cut(candidates)
    n_q, n_c = queries.count(), candidates.count()
    blocks, shards = max(1, -(-n_q // query_block)), max(1, -(-n_c // shard))
    q = queries.select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    c = candidates.select(F.col("id").alias("c_id"), F.col("v").alias("c_v"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def tile(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            l_dim, r_dim = left["q_v"].map(len).to_numpy(), right["c_v"].map(len).to_numpy()
            for d in np.intersect1d(l_dim, r_dim):
                a, b = left[l_dim == d], right[r_dim == d]
                for ids, found, s, more in top_of_tile(a["q_id"].to_numpy(), np.stack(list(a["q_v"])), b["c_id"].to_numpy(), np.stack(list(b["c_v"])), k):
                    out.append(pd.DataFrame({"query_id": ids, "vec_id": found, "score": s, "beyond": more}))
        if not out:
            return pd.DataFrame({"query_id": np.array([], "int64"), "vec_id": np.array([], "int64"), "score": np.array([], "int64"), "beyond": np.array([], object), "part": np.array([], "int32")})
        return pd.concat(out, ignore_index=True).assign(part=np.int32(key[1]))

    keys = ["block", "shard"]
    lists = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(tile, "query_id long, vec_id long, score long, beyond string, part int")
    best = [F.col("score").desc(), F.col("beyond").desc(), F.col("vec_id")]
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("part", F.col("part") % shards)
        lists = lists.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*best))).where(F.col("r") <= k).drop("r")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
