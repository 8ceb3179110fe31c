import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import mixing, sharding


def waterfill(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(full.values())) / max(1e-12, sum(w[s] for s in rest)) if rest else 0
        new = {s: 2.0 * sizes[s] for s in rest if level * w[s] > 2 * sizes[s]}
        if not new:
            return full | {s: level * w[s] for s in rest}
        full |= new


def test_mix_meets_targets(docs, words):
    rows = docs.withColumn("n", mixing.n_words(F.col("text")))
    assert all(r.n == len(words(r.text)) for r in rows.collect())
    documents, spans = mixing.mix(rows.select("doc_id", "source", F.col("n").alias("w")), size="w", block=16, per_shard=8)
    got = mixing.taken(documents, spans).collect()
    sizes = Counter()
    for r in rows.collect():
        sizes[r.source] += r.n
    want = waterfill(dict(sizes))
    assert len(got) == docs.count()
    by_target = {round(r.target, 6) for r in got}
    assert by_target == {round(t, 6) for t in want.values()}
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) == sum(int(t) for t in want.values())
    again = mixing.taken(*mixing.mix(rows.select("doc_id", "source", F.col("n").alias("w")), size="w", block=16, per_shard=8)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents(docs, no_docs):
    out = mixing.mixed_documents(docs, block=16)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r.n_chars == len(r.text) and r.text
    assert mixing.mixed_documents(no_docs).count() == 0
    assert mixing.mixed_documents(docs.where("text is null")).count() == 0


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 17, 1000):
        key = np.full(n, 77, np.uint64)
        image = mixing.permuted(np.arange(n), np.full(n, n), key)
        assert sorted(image) == list(range(n))
        assert mixing._place(n, np.uint64(77)) == int(np.flatnonzero(image == n - 1)[0])


def test_shard_draws_add_up():
    totals = np.array([100, 7, 0, 950])
    parts = [mixing.shard_counts(totals, 9, s, 3) for s in range(9)]
    assert (sum(own for _, own in parts) == totals).all()
    assert all((b == sum(own for _, own in parts[:i])).all() for i, (b, _) in enumerate(parts))


def test_large_draws_are_random():
    """Beyond what the library draws: the right mean and spread, and every seed draws anew."""
    totals = np.array([6 * 10**9, 2 * 10**9, 10**9, 0, 10])
    n = 3 * 10**9
    drawn = np.array([mixing._draw(np.random.default_rng(s), totals.copy(), n) for s in range(300)])
    assert (drawn.sum(axis=1) == n).all() and (drawn <= totals).all() and len({tuple(x) for x in drawn}) == 300
    share = totals[:3] / totals.sum()
    spread = np.sqrt(n * share * (1 - share) * (totals.sum() - n) / (totals.sum() - 1))
    assert (abs(drawn[:, :3].mean(axis=0) - n * share) < 5 * spread / np.sqrt(300)).all()
    assert (abs(drawn[:, :3].std(axis=0) / spread - 1) < 0.2).all()
    counts = [tuple(mixing.shard_counts(totals, 4, 0, seed)[1]) for seed in (1, 2, 3)]
    assert len(set(counts)) == 3


def test_numbers_beyond_one_span(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "SPAN", 4)
    df = spark.range(500).selectExpr("id", "if(id % 3 = 0, null, id % 3) as k")
    got = {}
    for r in common.numbered(df, ["k"], [F.col("id")], "n", rows_per_bucket=20).collect():
        got.setdefault(r.k, []).append(r.n)
    assert {k: sorted(x) for k, x in got.items()} == {k: list(range(len(x))) for k, x in got.items()} and set(got) == {None, 1, 2}


def test_growth_law_needs_the_founding_tree(spark):
    import pytest

    with pytest.raises(ValueError):
        sharding.topology(15)
    df = spark.range(3000).select(*[sharding.place(F.col("id"), sharding.topology(n, 1, 1, 1)).alias(f"s{n}") for n in range(1, 18)])
    for r in df.collect():
        assert all(r[f"s{n + 1}"] in (r[f"s{n}"], n) for n in range(1, 17))


def test_shards_by_an_own_descent(spark):
    """Every level by hand: -ln(u) / weight of each child, u from the hash of its name, the seed and the key."""
    import math

    names = [f"{p}" for r in range(4) for p in [f"/r{r}"]] + [f"/r{r}/k{k}" for r in range(4) for k in range(2)] + [f"/r{r}/k{k}/{s}" for r in range(4) for k in range(2) for s in range(r * 4 + k * 2, r * 4 + k * 2 + 2)]
    keys = spark.range(200).select("id", *[F.xxhash64(F.lit(n), F.lit(17), F.col("id")).alias(n) for n in names], sharding.place(F.col("id"), sharding.topology(16)).alias("shard"))
    for r in keys.collect():
        draw = lambda n, w: -math.log((((r[n] % 2**64) >> 11) + 1) / 2**53) / w  # noqa: B023, E731
        region = min((draw(f"/r{x}", 4), x) for x in range(4))[1]
        rack = min((draw(f"/r{region}/k{x}", 2), x) for x in range(2))[1]
        shard = min((draw(f"/r{region}/k{rack}/{x}", 1), x) for x in range(region * 4 + rack * 2, region * 4 + rack * 2 + 2))[1]
        assert r.shard == shard


def test_sharding(docs, no_docs, spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id")).unionByName(docs.select("doc_id"))
    out = sharding.shard_rows(rows, "doc_id", sharding.topology(16), sharding.topology(17)).collect()
    per = {}
    for r in out:
        per.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert len(out) == 4000 + docs.count() and all(sorted(x) == list(range(len(x))) for x in per.values())
    assert set(per) == set(range(16)) and max(map(len, per.values())) < 2 * min(map(len, per.values()))
    assert sharding.shard_rows(no_docs.select("doc_id"), "doc_id", sharding.topology(16)).count() == 0


def test_a_changed_weight_moves_rows_only_through_its_subtree(spark):
    leaves = sharding.topology(16)
    heavier = [x if x.shard != 5 else sharding.Leaf(x.region, x.rack, x.shard, 2.0) for x in leaves]
    of = {x.shard: x.region for x in leaves}
    df = spark.range(3000).select(sharding.place(F.col("id"), leaves).alias("a"), sharding.place(F.col("id"), heavier).alias("b"))
    moved = [(r.a, r.b) for r in df.collect() if r.a != r.b]
    assert moved and all(of[b] == of[5] for _, b in moved)


def test_query_columns(spark, sf_dir):
    from tidemark.llm.queries import op1_mixing, op4_sharding

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op4_sharding(spark, sf_dir).collect():
        text = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
    assert op1_mixing(spark, sf_dir).count() == len(docs)
