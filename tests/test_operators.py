"""Operators against small literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores, urls
from tidemark.operators import dedup, extract, filters, leaks, reports, similarity
from tidemark.sources import readers, writers
from tidemark.streaming import state


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "url string").select(f(F.col("url")).alias("x")).first().x


@pytest.mark.parametrize("f, url, want", [
    (urls.structure, "http://h/a/12/x-7.html?b=1&a=2", "http://h/a/{num}/x-{num}.html?a=&b="),
    (urls.structure, "http://h/550e8400-e29b-41d4-a716-446655440000/0123456789abcdef/", "http://h/{uuid}/{hash}/"),
    (urls.structure, "http://h/abc12/12abc", "http://h/abc{num}/{num}abc"),
    (urls.param_pattern, "https://h/p?b=2&a=1#f", "https://h/p?a=&b="),
    (urls.canonical, "HTTP://H:80//a//b/?utm_source=x&z=1&a=2#f", "http://h/a/b?a=2&z=1"),
    (urls.without_session, "http://h/p?sid=1&b=2", "http://h/p?b=2"),
    (urls.base_domain, "http://a.b.com.cn/", "b.com.cn"),
    (urls.similar_pattern, "http://h/1/2/a-3", "http://h/{id}/2/a-{id}".replace("/2/", "/{num}/")),
    (scores.value_class, "123456", "num_6_10"), (scores.value_class, "1234567", "hex"), (scores.value_class, "abcdefghijk", "base64"),
    (scores.url_type, "http://h/users/12", "RESTful"), (scores.url_type, "http://h/a?x=1&y=2", "MultiParam"), (scores.url_type, "http://h/x.png", "StaticAsset"),
])
def test_scalars(spark, f, url, want):
    assert one(spark, url, f) == want


def test_params_and_resolve(spark):
    assert [tuple(p) for p in one(spark, "http://h/p?a=1&a=%41&b", urls.params)] == [("a", "1"), ("a", "A"), ("b", "")]
    base = F.lit("https://h/d/p.html?q=1")
    for link, want in [("//o/x", ["https://o/x", "http://o/x"]), ("/r", ["https://h/r"]), ("y", ["https://h/d/y"]), ("#t", []), ("ftp://z", ["ftp://z"])]:
        assert one(spark, link, lambda c: urls.resolve(base, c)) == want


def test_private_addresses(spark):
    for h, want in [("10.1.2.3", True), ("172.20.0.1", True), ("8.8.8.8", False), ("a.b", False)]:
        assert one(spark, h, urls.is_private_ipv4) is want


@pytest.mark.parametrize("url, action", [("", "reject"), ("javascript:x", "reject"), ("http://example.com/a#fff", "reject"), ("http://other.net/", "degrade"), ("http://example.com/x.js", "allow"), ("http://example.com/x.png", "degrade"), ("http://example.com/admin", "allow")])
def test_chain(spark, url, action):
    assert one(spark, url, lambda c: filters.judge(c, filters.preset("balanced", "example.com")))["action"] == action


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract.links(empty).count() == 0
    assert dedup.groups(empty, urls.param_pattern(F.col("url")), "url").count() == 0
    assert one(spark, None, urls.structure) is None


def test_pairing_is_last_in_first_out(spark):
    rows = [(i, "u", k) for i, k in enumerate("((x)))()")]
    df = spark.createDataFrame(rows, "id int, url string, k string")
    got = reports.pair_last_open(df, "url", ["id"], "id", F.col("k") == "(", F.col("k") == ")")
    assert sorted((r.opened, r.closed) for r in got.collect()) == [(0, 4), (1, 3), (6, 7)]


def test_redirects(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "original string, final string")
    assert {r.original: (r.final, r.hops) for r in reports.chains(df).collect()} == {"a": ("d", 3), "b": ("d", 2), "c": ("d", 1)}


def test_forms_and_assets(spark):
    html = "<form action='/go' method='post'><input name='e' type='email' required><input type='submit' name='s'><input name='q' value='1 2'></form><img src='a.png'><link href='s.css'>"
    pages = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    got = extract.form_requests(extract.forms(pages)).first()
    assert (got.method, got.action, got.body) == ("POST", "/go", "e=test%40example.com&q=1+2")
    assert {r.asset for r in extract.assets(pages).collect()} == {"a.png", "s.css"}


def test_similarity(spark):
    df = spark.createDataFrame([(1, "<a><b></b><b></b></a>"), (2, "<a><b></b><b></b></a>"), (3, "<a><b></b><i></i></a>")], "page_id long, html string")
    signed = similarity.signatures(df)
    rows = {r.page_id: r for r in signed.collect()}
    assert rows[1].struct_hash == rows[2].struct_hash != rows[3].struct_hash and rows[1].simhash == rows[2].simhash
    x = signed.where("page_id = 1").select(F.col("tags").alias("p"), F.col("counts").alias("c")).crossJoin(signed.where("page_id = 3").select("tags", "counts"))
    got = x.select(similarity.sequence_similarity("p", "tags").alias("s"), similarity.cosine(F.col("c"), F.col("counts")).alias("c")).first()
    assert abs(got.s - 2 / 3) < 1e-9 and abs(got.c - 3 / (5**0.5 * 3**0.5)) < 1e-9


def test_leak_rules(spark):
    rules = leaks.rules_from_json(spark, json.dumps({"rules": {"_x": {"pattern": "a"}, "k": {"pattern": "key-\\d+\n", "severity": "high", "mask": True}, "e": {"pattern": ""}}}))
    assert [tuple(r) for r in rules.collect()] == [("k", "key-\\d+", "HIGH", True)]
    df = spark.createDataFrame([(1, "x\nkey-1234567890 key-1")], "id long, t string")
    got = sorted((r.line_no, r.full_value, r.value) for r in leaks.scan(df, "id", "t", [tuple(r) for r in rules.collect()]).collect())
    assert got == [(2, "key-1", "*****"), (2, "key-1234567890", "key-******7890")]


def test_readers(spark, tmp_path):
    har = {"log": {"version": "1", "entries": [{"request": {"method": "POST", "url": "http://h/api/x", "postData": {"params": [{"name": "a", "value": "1"}]}}, "response": {"status": 200}}]}}
    (tmp_path / "a.har").write_text(json.dumps(har))
    r = readers.har(spark, str(tmp_path / "a.har")).first()
    assert (r.url, r.status, r.is_api, r.params[0]["name"]) == ("http://h/api/x", 200, True, "a")
    (tmp_path / "b.xml").write_text("<items><item><url>http://h/p</url><method>POST</method><status>200</status><request>POST / x\n\na=1&amp;b=2=3</request></item></items>")
    assert [tuple(p) for p in readers.proxy_xml(spark, str(tmp_path / "b.xml")).first().params] == [("a", "1"), ("b", "2=3")]
    (tmp_path / "s.xml").write_text("<urlset><url>\n<loc>http://h/1</loc></url></urlset>")
    assert readers.sitemaps(spark, str(tmp_path / "s.xml")).first().loc == "http://h/1"
    (tmp_path / "robots.txt").write_text("# c\nDisallow: /\nDisallow: /x/*\nSitemap: http://h/s.xml\n")
    assert {tuple(r) for r in readers.robots(spark, str(tmp_path / "robots.txt"), "http://h/").collect()} == {("Disallow", "http://h/x/"), ("Sitemap", "http://h/s.xml")}
    (tmp_path / "c.json").write_text('[["k","t","original"],["a","b","http://h/o"]]')
    assert readers.archive_index(spark, str(tmp_path / "c.json")).first().url == "http://h/o"
    (tmp_path / "u.txt").write_text("# x\n\n http://h/1\n{\"url\": \"http://h/2\"}\n")
    assert {r.url for r in readers.url_list(spark, str(tmp_path / "u.txt")).collect()} == {"http://h/1", "http://h/2"}
    (tmp_path / "k.txt").write_text("a=1; b=2=3\n")
    assert {(r.name, r.value) for r in readers.cookies(spark, str(tmp_path / "k.txt"), "pairs").collect()} == {("a", "1"), ("b", "2=3")}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("/a", "GET", ["x", "y"]), ("/a", "GET", ["x"]), ("/a", "POST", [])], "path string, method string, parameters array<string>")
    doc = json.loads(writers.openapi_paths(rows).first().document)
    assert set(doc) == {"get", "post"} and [p["name"] for p in doc["get"]["parameters"]] == ["x", "y"]
    writers.url_text(spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "url string"), "url", str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).orderBy("value").collect()] == ["a", "b"]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("a", 4.0)], "k string, v double").coalesce(1).write.json(str(src))
    stream = spark.readStream.schema("k string, v double").json(str(src))
    for name, df, mode in (("cap", state.capped(stream, F.col("k"), 2), "append"), ("first", state.first_seen(stream, F.col("k")), "append"), ("ema", state.moving_adjustment(stream, "k", "v"), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.k for r in spark.table("cap").collect()) == ["a", "a", "b"]
    assert sorted(r.k for r in spark.table("first").collect()) == ["a", "b"]
    assert {r.key: r.n for r in spark.table("ema").collect()} == {"a": 3, "b": 1}
