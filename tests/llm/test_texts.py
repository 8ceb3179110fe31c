import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import near_texts, quality, toxicity, url_filter
from tidemark.llm.labelled import held_out, sample


def shingles(t, words):
    w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, words):
    sets = [(i, shingles(t, words)) for i, t in rows if i is not None]
    links = {}
    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                links.setdefault(i, set()).add(j)

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen)

    return {i: least(i) for i, _ in sets}


def check(df, words):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows, words)
    got = near_texts.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(i), len(shingles(t, words))) for i, t in rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.component_id == r.doc_id)


def test_near_texts_on_odd_rows(docs, no_docs, words):
    check(docs, words)
    assert near_texts.near_duplicates(no_docs).count() == 0


def test_near_texts_in_groups(spark, words, monkeypatch):
    rnd = random.Random(2)
    rows, vocabulary = [], [f"t{i}" for i in range(400)]
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.randint(1, 12)):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    monkeypatch.setattr(near_texts, "TILE", 8)
    monkeypatch.setattr(near_texts, "FAMILY_TILE", 4)
    check(spark.createDataFrame(rows, "doc_id long, text string"), words)


def test_held_out(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def both(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def auc(rows):
    good, bad = ([r.score for r in rows if r.y == y] for y in (1, 0))
    return np.mean([[a > b for b in bad] for a in good]) if good and bad else 1.0


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.85)])
def test_classifiers_on_held_out_rows(spark, module, label, least):
    docs, labels = both(spark, "/root/testdata/sf0.01")
    scored = module.score(docs, module.fit(docs, labels), keep=["doc_id"])
    rows = scored.join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", F.col(label).alias("y")).collect()
    assert auc(rows) >= least and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, docs, no_docs, module, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    some = spark.createDataFrame([(1, 1), (2, None), (3, 0), (None, 1), (99, 0), (1, 1)], f"doc_id long, {label} int")
    for labels in (none, some):
        model = module.fit(docs, labels)
        rows = module.score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 4}) == 1
        assert module.score(no_docs, model).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_positive_unlabelled_risk(share):
    """Without a negative label: the prior is found, and the classes of the unlabelled rows are told apart."""
    rng = np.random.default_rng(1)
    k, n = len(quality.FEATURES), 4000
    y = rng.random(n) < share
    unl = rng.standard_normal((n, k)) + np.where(y, 1.0, -1.0)[:, None]
    model = quality.fit_features(rng.standard_normal((500, k)) + 1, quality.Pool(unl))
    assert abs(model.prior - share) < 0.08
    assert ((model.score(unl) > 0.5) == y).mean() > 0.9


def test_the_risk_does_not_fall_below_zero():
    rng = np.random.default_rng(2)
    k = len(quality.FEATURES)
    pos, unl = rng.standard_normal((4, k)) + 1, rng.standard_normal((12, k))
    pool = quality.Pool(unl)
    model = quality.fit_features(pos, pool, 0.5)
    w = np.append(model.weights, model.bias)
    z_u, z_p = (np.hstack([model.expand(x), np.ones((len(x), 1))]) @ w for x in (unl, pos))
    assert np.logaddexp(0, z_u).mean() - 0.5 * np.logaddexp(0, z_p).mean() >= -1e-9


def test_quality_from_positives_alone(spark):
    docs, labels = both(spark, "/root/testdata/sf0.01")
    full, alone = (quality.fit(docs, x) for x in (labels, labels.where("quality = 1")))
    assert full.prior == alone.prior < 0.97 and (full.weights == alone.weights).all()


def test_sample_is_bounded(spark):
    """An id that stands many times, in documents and labels, is one row."""
    docs = spark.createDataFrame([(1, f"t{i:03}") for i in range(300)] + [(i, "x") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(i, i % 2) for i in range(2, 30)] + [(3, 0), (99, 1)], "doc_id long, q int")
    rows = sample(docs, labels, "q", 10, 10).collect()
    assert len(rows) == 20 and len({(r.id, r.label is None) for r in rows}) == 20
    rows = sample(docs, labels, "q", 100, each=True).collect()
    assert {r.id for r in rows} == {i for i in range(1, 30) if i != 3 and zlib.crc32(str(i).encode()) % 5}
    assert [r.text for r in rows if r.id == 1] in ([], ["t000"])


def test_subsequence_kernel_against_its_definition():
    from itertools import combinations

    def k(s, t):
        total = 0.0
        for i in combinations(range(len(s)), toxicity.ORDER):
            for j in combinations(range(len(t)), toxicity.ORDER):
                if [s[a] for a in i] == [t[b] for b in j]:
                    total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    units = ["idiot", "idxiot", "stupid", "abcdefab", "ab"]
    marks = toxicity.Landmarks(["idiot", "stupids", "aabcd"])
    got = marks.kernel(units)
    for a, u in enumerate(units):
        for b, m in enumerate(marks.units):
            want = k(u, m) / np.sqrt(k(u, u) * k(m, m)) if k(u, u) else 0.0
            assert abs(got[a, b] - want) < 1e-9


def test_large_alphabets(monkeypatch):
    """Landmarks of any characters; the searched table gives what the one looked up by place gives."""
    units = ["".join(chr(0x4E00 + 7 * i + j) for j in range(6)) for i in range(60)]
    marks = toxicity.Landmarks([*units, "idiot"])
    assert np.allclose(np.diag(marks.kernel(marks.units)), 1) and marks.base**toxicity.ORDER > 10**10
    small = ["idiot", "stupid", "idixot", "xidiot", "ids\0"]
    want = toxicity.Landmarks(small[:2]).kernel(small)
    monkeypatch.setattr(toxicity, "MAX_TABLE", 1)
    searched = toxicity.Landmarks(small[:2])
    assert np.allclose(searched.kernel(small), want) and searched.size > 1


def test_folded_decision_function():
    """The table gives what kernel values with the landmarks, times the support vector machine's weights, give."""
    rng = np.random.default_rng(5)
    calm = ["table", "window", "garden", "river", "music", "paper", "house", "green", "of", "the"]
    toxic = [" ".join([*rng.choice(calm, 4, replace=False), w]) for w in ["idiot", "moronic", "ugh"] * 20]
    kept = {}
    solve = toxicity.svm
    try:
        toxicity.svm = lambda x, y, c: kept.setdefault("w", []).append(solve(x, y, c)) or kept["w"][-1]
        model = toxicity.fit_units(toxic, [" ".join(rng.choice(calm, 5, replace=False)) for _ in range(60)])
    finally:
        toxicity.svm = solve
    w, bias = kept["w"][-1]
    marks = model.landmarks
    value, vector = np.linalg.eigh(marks.kernel(marks.units))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    units = ["idiot", "idxiot", "moron", "garden", "ugh\0", "of\0\0", "zzzzz"]
    assert np.allclose(model.values(units), marks.kernel(units) @ root @ w + bias, atol=1e-5)
    v = model.values(units)
    assert min(v[0], v[1], v[4]) > max(v[3], v[5], v[6])


def test_long_toxic_texts_teach(spark):
    """Where every labelled toxic text is long, the model still tells texts apart."""
    rnd = random.Random(4)
    calm = [f"word{i}" for i in range(300)]
    def text(bad, n):
        return " ".join(rnd.choice(calm) for _ in range(n)) + (" you idiot moronic scum" if bad else "")
    rows = [(i, text(i % 2, 1500 if i % 2 else 60)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    test = spark.createDataFrame([(0, text(False, 80)), (1, text(True, 80))], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(test, model).collect()}
    assert score[1] > 0.5 > score[0]


def test_gapped_words_are_read():
    assert "idiot" in toxicity.tokens("you i d i o t") and "idiot" in toxicity.windows("i.d.i.o.t")


def test_urls(spark):
    model = url_filter.fit(spark)
    rows = [
        ("https://A.Example.ORG/es/1?q", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12#x", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"), ("http://org", "org", "", None, None),
        ("http://notexample.com/fr/x", "notexample.com", "/fr/x", "com/fr/", "allow"), ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("http://É.net/a\nb?c", "É.net", "/a\nb", None, None), ("x://" + "a" * 5000, "a" * 5000, "", None, None),
        ("http://casino-bonus-777.win/free-spins/bet", "casino-bonus-777.win", "/free-spins/bet", None, "block"),
    ]
    df = spark.createDataFrame([(i, r[0], "clash") for i, r in enumerate(rows)], "page_id int, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df, model).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(rows):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and verdict in (None, r.verdict) and r.verdict in ("allow", "block")
    assert url_filter.judge(df.where("false"), model).count() == 0
    grams = spark.range(1).select(url_filter.gram_buckets(F.lit("ab.c"), F.lit(""), 2048, (3, 4)).alias("g")).first().g
    z = sum(model.weights[g] for g in grams) / len(grams) + model.bias
    p = spark.range(1).select(url_filter.blocked_probability(F.lit("ab.c"), F.lit(""), model).alias("p")).first().p
    assert abs(p - 1 / (1 + np.exp(-z))) < 1e-12


def test_held_out_urls(spark):
    """Labelled URLs that the model has not seen."""
    good = ["https://www.opera.org/season/tickets", "https://docs.python-guide.net/en/latest/", "https://city.museum.fr/expositions/2020", "http://www.botany.edu/plants/oak.html", "https://news.village.com/sports/result"]
    bad = ["http://free-casino-slots.top/win", "http://cheap-viagra.shop/order-now", "http://hot-porn-cams.xyz/sex", "http://keygen-crack-warez.club/download", "http://payday-loans-bonus.click/apply"]
    df = spark.createDataFrame([(u,) for u in good + bad], "url string")
    verdict = {r.url: r.verdict for r in url_filter.judge(df, url_filter.fit(spark), rules=[]).collect()}
    assert [verdict[u] for u in good + bad] == ["allow"] * 5 + ["block"] * 5


def test_probability_by_hand(spark):
    """Hashed n-grams of ^host$ and ^path$, averaged, under the model's weights: written out in Python."""
    model = url_filter.UrlModel([float(i % 7) - 3 for i in range(64)], 0.25, (3, 4))
    host, path = "ab.example", "/x"
    grams = [(f, m[i : i + n]) for f, m in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in (3, 4) for i in range(max(1, len(m) - n + 1))]
    hashed = spark.createDataFrame(grams, "f string, g string").select(F.pmod(F.xxhash64("f", "g"), F.lit(64)).alias("b")).collect()
    z = sum(model.weights[r.b] for r in hashed) / len(grams) + 0.25
    p = spark.range(1).select(url_filter.blocked_probability(F.lit(host), F.lit(path), model).alias("p")).first().p
    assert abs(p - 1 / (1 + np.exp(-z))) < 1e-12


def test_refused_percent(docs):
    with pytest.raises(ValueError):
        near_texts.near_duplicates(docs, percent=50)
