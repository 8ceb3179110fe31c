"""Operators that compare or search everything, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import extract, responses, similarity
from tidemark.plans import more, registry  # noqa: F401


@pytest.mark.parametrize("shard", [9, 10_000])
def test_best_match_of_all_pages(spark, sf_dir, shard):
    pages = registry.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), responses.page_embedding("html").alias("v")).checkpoint()
    pages = pages.unionByName(pages.where("id < 9 or id = 40").selectExpr("id + 1000 as id", "v"))  # exact copies: ties
    rows = {r.id: np.array(r.v) for r in pages.collect()}
    got = {r.id: (r.cosine, r.other) for r in responses.best_match(pages, shard).collect()}
    assert got.keys() == rows.keys() and max(o for _, o in got.values()) >= 1000
    for i, v in rows.items():
        c, j = max((round(float(v @ w), 6), -j) for j, w in rows.items() if j != i)
        assert got[i][1] == -j and abs(got[i][0] - c) < 2e-6
    assert responses.best_match(pages.where("id = 1")).collect()[0][1:] == (None, None) and responses.best_match(pages.where("false")).count() == 0


def test_best_match_query_has_all_pages_as_candidates(spark, sf_dir):
    got = registry.QUERIES["page_best_match"](spark, sf_dir).collect()
    assert len(got) == registry.table(spark, sf_dir, "pages").count() and any(r.other >= 20 for r in got)


def test_subdomains_in_texts_too(spark, sf_dir):
    pages = registry.table(spark, sf_dir, "pages")
    want = set()
    for r in pages.collect():
        texts = re.findall(r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+example\.com\b", r.html or "")
        want |= {h.lower() for h in [*texts, re.match(r"\w+://([^/?#:]*)", r.url)[1]] if h.lower().endswith(".example.com")}
    assert {(r.subdomain, r.level) for r in registry.QUERIES["page_subdomains"](spark, sf_dir).collect()} == {(h, h.count(".") - 1) for h in want}
    html = "<a href='https://Only.Link.example.com/x'>see text.example.com, notexample.com</a><script>u='//js.example.com/'</script>"
    one = spark.createDataFrame([(1, "http://www.example.com/", html)], "page_id long, url string, html string")
    assert {r.subdomain for r in extract.subdomains(one, "example.com").collect()} == {"only.link.example.com", "text.example.com", "js.example.com", "www.example.com"}


@pytest.mark.parametrize("shard", [7, 512])
def test_similar_structures_against_all_pairs(spark, shard):
    random.seed(5)
    kinds = ["div", "p", "a", "ul", "li", "span", "img", "table", "tr", "td"]
    base, rows = [[random.choice(kinds) for _ in range(60)] for _ in range(4)], []
    for i in range(80):
        t = list(base[i % 4])
        for _ in range(random.randrange(16)):
            t[random.randrange(len(t))] = random.choice(kinds)
        rows.append((i, "".join(f"<{x}>" for x in t + ["b"] * random.randrange(6))))
    rows += [(100, rows[0][1]), (101, ""), (102, "<a>" * 300), (103, "<a>" * 280)]
    signed = similarity.signatures(spark.createDataFrame(rows, "page_id long, html string")).checkpoint()
    reps = signed.groupBy("struct_hash").agg(F.min_by(F.struct("page_id", "tags", "simhash", "counts", "n"), "page_id").alias("r")).select("r.*")
    a, b = (reps.select(*[F.col(c).alias(f"{p}_{c}") for c in reps.columns]) for p in "ab")
    score = similarity.sequence_similarity("a_tags", "b_tags") + similarity.hamming_similarity(F.col("a_simhash"), F.col("b_simhash")) + F.try_divide(F.least("a_n", "b_n"), F.greatest("a_n", "b_n")) + similarity.cosine(F.col("a_counts"), F.col("b_counts"))
    every = a.join(b, F.col("a_page_id") < F.col("b_page_id")).select("a_page_id", "b_page_id", F.round(score / 4, 6).alias("s"), F.col("a_simhash").bitwiseXOR(F.col("b_simhash")).alias("x"))
    want = [r for r in every.collect() if r.s is not None and r.s >= 0.85]
    assert any(all(r.x >> 16 * k & 65535 for k in range(4)) for r in want)  # pairs without an equal block
    got = {(r.a, r.b): r.similarity for r in similarity.similar_structures(signed, shard=shard).collect()}
    assert got.keys() == {(r.a_page_id, r.b_page_id) for r in want}
    assert all(abs(got[r.a_page_id, r.b_page_id] - r.s) < 1e-9 for r in want)


def test_leaders_are_those_of_one_pass_in_order(spark):
    import random

    from tidemark.operators import trees

    rng = random.Random(3)
    n = 60
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(110)} | {(i, i + 1) for i in range(50, 59)})
    near = {(a, b) for a, b in pairs}
    stored, want = [], {}
    for i in range(n):
        hit = next((s for s in stored if (s, i) in near), None)
        want[i] = (i if hit is None else hit, hit is None)
        if hit is None:
            stored.append(i)
    got = trees.leaders(spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["id"]: (r["leader"], r["kept"]) for r in got} == want and len(got) == n


def test_leaders_without_pairs_or_pages(spark):
    from tidemark.operators import trees

    none = spark.createDataFrame([], "a long, b long")
    assert [tuple(r) for r in trees.leaders(spark.createDataFrame([(4,)], "id long"), none).collect()] == [(4, 4, True)]
    assert trees.leaders(spark.createDataFrame([], "id long"), none).count() == 0


def test_technologies_keep_the_pages_columns_and_headers_in_any_case(spark):
    from tidemark.operators import technology

    df = spark.createDataFrame([(1, "x", {"SERVER": "nginx/1.2", "server": "Apache"}), (2, None, None)], "name long, html string, headers map<string,string>")
    got = technology.technologies(df.withColumnRenamed("name", "page_id"), headers="headers").collect()
    assert [(r["page_id"], r["name"], r["version"]) for r in got] == [(1, "Nginx", "1.2")]
