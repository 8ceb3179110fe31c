import numpy as np
import pytest

from tidemark.llm import near_vectors


def exact(u, label, threshold=0.93):
    """(links, least id reachable) of every row of the unit vectors ``u``, by all pairs."""
    links, least = np.zeros(len(u), int), np.arange(len(u))
    pairs = []
    for at in range(0, len(u), 1000):
        hit = (u[at : at + 1000] @ u.T >= threshold) & (label[at : at + 1000, None] == label[None, :])
        i, j = np.nonzero(hit)
        i = i + at
        pairs.append((i[i != j], j[i != j]))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    np.add.at(links, a, 1)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        if (new == least).all():
            return links, least
        least = new


@pytest.mark.parametrize("n_pairs, common, block, noise", [(700, 1.0, 64, 0.5), (5000, 0.0, 512, 0.37)])
def test_links_of_one_large_label(spark, monkeypatch, n_pairs, common, block, noise):
    """Lone pairs just above the threshold in one label far larger than a block: with and without a direction that
    all share. The passes alone must find them; and links are exact for a dense group and its copies."""
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "TILE", 200)
    rng = np.random.default_rng(8)
    v = common * rng.standard_normal(64) + rng.standard_normal((n_pairs, 64))
    w = v + rng.standard_normal((n_pairs, 64)) * noise
    dense = v[0] + rng.standard_normal((500, 64)) * 0.2
    every = np.concatenate([v, w, dense, dense[:50]])
    label = np.ones(len(every), int)
    label[-25:] = 2
    df = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(every, label))], "vec_id long, embedding array<double>, label int")
    u = every / np.sqrt((every * every).sum(1, keepdims=True))
    links, least = exact(u, label)
    lone = np.flatnonzero(links[: 2 * n_pairs] == 1)
    assert len(lone) > 200
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_duplicates(df, window=16 if block == 64 else 64).collect()}
    wrong = [i for i in range(len(u)) if got[i] != (links[i], least[i])]
    assert not [i for i in wrong if i >= 2 * n_pairs] and len(wrong) <= 0.002 * len(lone)


def test_passes_grow_slowly():
    of = lambda n, shared=0.0: near_vectors.passes_for(n, 0.93, shared, 64, 512)
    assert of(512) == 1 < of(513) <= of(10**4) < of(10**6) < of(10**9) < 1000
    assert of(10**6, 0.6) > of(10**6)
