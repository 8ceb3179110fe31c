import random

import numpy as np
import pytest

from tidemark.llm import near_vectors, topk


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows, base = [], rng.standard_normal((6, 8))
    for i in range(120):
        v = base[i % 6] + rng.standard_normal(8) * (0.15 if i < 90 else 3)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 6 // 3), "x"))
    rows += [(200, rows[0][1], 0, "x"), (201, rows[0][1], 1, "x"), (202, rows[0][1], None, "x"), (203, None, 0, "x"), (204, [0.0] * 8, 0, "x"), (205, [float("nan")] + [1.0] * 7, 0, "x"), (206, [None] + [1.0] * 7, 0, "x"), (207, [1.0] * 3, 0, "x"), (208, [], 0, "x"), (None, rows[0][1], 0, "x"), (0, rows[0][1], 0, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string")


def test_near_vectors_against_all_pairs(vectors):
    rows = [r for r in vectors.collect()]
    good = {}
    for r in rows:
        v = r.embedding
        if r.vec_id is not None and r.label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[r.vec_id] = (r.label, np.array(v, float))
    links = {i: set() for i in good}
    for i, (a, x) in good.items():
        for j, (b, y) in good.items():
            if i != j and a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[i].add(j)

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen)

    got = near_vectors.near_duplicates(vectors, n_passes=12, window=16).collect()
    assert len(got) == len(rows) and any(links.values())
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (len(links.get(r.vec_id, ())), least(r.vec_id), least(r.vec_id) == r.vec_id)
    assert near_vectors.near_duplicates(vectors.where("false")).count() == 0


@pytest.mark.parametrize("scale, block, shard", [(256, 7, 13), (2**50, 100, 1000)])
def test_top_k_against_sorting(vectors, scale, block, shard):
    ints = topk.to_integers(vectors, "vec_id", "embedding", scale)
    rows = {(r.id, tuple(r.v)) for r in ints.collect()}
    got = {}
    if scale == 2**50:
        ints = ints.selectExpr("id", "transform(v, x -> cast(x as bigint) div 1125899906842L) as v")  # long products beyond 2**53
        rows = {(r.id, tuple(r.v)) for r in ints.collect()}
    for r in topk.top_k(ints.where("id % 10 = 0"), ints, 4, query_block=block, shard=shard).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for i, v in rows:
        if i % 10 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i and len(v) == len(w))[:4]
            assert sorted(got.get(i, [])) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]


def test_ties_go_to_the_smaller_id():
    parts = list(topk.top_of_tile(np.array([1]), np.array([[1, 1]]), np.array([9, 1, 4, 7, 3]), np.array([[1, 1]] * 5), 3))
    found = np.concatenate([x[1] for x in parts])
    assert found.tolist() and sorted(found.tolist()) == [3, 4, 7]


def test_merges_in_a_tree(spark):
    random.seed(1)
    df = spark.createDataFrame([(i, [random.randint(-9, 9)]) for i in range(200)], "id long, v array<long>")
    rows = {r.id: r.v[0] for r in df.collect()}
    got = topk.top_k(df.where("id < 3"), df, 5, shard=5).orderBy("query_id", "rank").collect()
    for q in range(3):
        want = [j for _, j in sorted((-rows[q] * x, j) for j, x in rows.items() if j != q)[:5]]
        assert [r.vec_id for r in got if r.query_id == q] == want


@pytest.mark.parametrize("shard", [2, 1000])
def test_vectors_of_any_finite_size_take_part(spark, shard):
    """Scores beyond a long are the nearest long, in the order of the whole scores; no finite vector is left out."""
    rows = [(0, [1.0, 0.5]), (1, [1e30, 0.0]), (2, [3.4e38, 1.0]), (3, [-1e300, 0.0]), (4, [-1e301, 0.0]), (5, [1.7e308, 0.0]), (6, [0.25, 0.25]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<double>, id string, v string")
    ints = topk.to_integers(df, "vec_id", "embedding", 256)
    assert {r.id for r in ints.collect()} == set(range(7))
    got = topk.top_k(ints.where("id = 0"), ints, 6, shard=shard).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [5, 2, 1, 6, 3, 4]
    assert [r.score for r in got][:4] == [2**63 - 1] * 3 + [256 * 64 + 128 * 64] and got[5].score == -(2**63)
    assert topk.top_k(ints.where("false"), ints, 3).count() == 0 == topk.top_k(ints, ints.where("false"), 3).count()
