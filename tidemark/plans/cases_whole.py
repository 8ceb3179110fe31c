"""Queries over literal cases of markup, scripts, technologies, learning and captures, with values worked out by hand, and
two over whole pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import filters, markup, reports, scripts, similarity, technology, trees
from tidemark.plans import pipelines
from tidemark.plans.cases import _cases, _literal, _text
from tidemark.plans.registry import ORACLE, QUERIES, table


def _pairs(found, *fields):
    return _text(F.transform(found, lambda x: F.concat_ws(" ", *[x[f].cast("string") for f in fields])))


def _rows(name: str, run, columns: list[str], rows: list[tuple]) -> None:
    """Register ``run`` with literal rows as its oracle."""
    QUERIES[name] = run
    ORACLE[name] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({', '.join(columns)})"


_cases("cases_page_links", "html string", lambda: [_pairs(markup.page_links(F.col("html")), "kind", "link")], [
    ('<a href="/x?a=1&amp;b=2">q</a><A HREF=\'//cdn.a.com/y\'>z</A>', "a /x?a=1&b=2 | a //cdn.a.com/y"),
    ("<a href=bare.html>b</a><a href='#top'>t</a><a href=''>e</a><a name=\"n\">n</a>", "a bare.html"),
    ('<a href="mailto:a@b.c"></a><a href="TEL:1"></a><a href="ftp://f/x"></a><a href="wss://w"></a><a href="data:x"></a>', ""),
    ("<a href=\"javascript:load('art.php')\">j</a><a href=\"javascript:void(0)\">v</a>", "call art.php"),
    ('<form action="/post"><form action="javascript:x"><form action=""><iframe src="/f"></iframe><frame src="g">', "form /post | iframe /f | frame g"),
    ('<embed src="/e.swf"><object data="/o.pdf"></object><area href="/ar"><base href="/b/">', "embed /e.swf | object /o.pdf | area /ar | base /b/"),
    ('<meta http-equiv="Refresh" content="0; URL=\'/Next\'"><meta http-equiv="refresh" content="5"><meta name="x" content="0;url=/no">', "refresh /next"),
    ('<div data-url="/d" data-target="#t" data-src="rel" data-ajax="http://h/p">', "data /d | data http://h/p"),
    ("<b onclick=\"if (a>b) { location.href='/go/now' }\">s</b>", "event /go/now"),
    ('<button data-action="/act" data-target="#m">k</button><i role="button" data-action="/i">', "button /act | button /i"),
    ('<!-- <a href="/no"> --><script>var x = \'<a href="/in">\';</script><style><a href="/st"></style>', ""),
    ("<a title=it's href=\"/k\">x</a>", "a /k"), ("", ""), (None, None), ('<a href="x', ""), ("<abbr href='/x'>", ""),
], ["links"])

_cases("cases_page_assets", "html string", lambda: [_pairs(markup.page_assets(F.col("html")), "kind", "link")], [
    ('<img src=a.png srcset="a.png 1x, b.png 2x"><source srcset="c.png 320w,b.png"><link href="s.css"><script src="j.js"></script>', "link s.css | script j.js | img a.png | srcset b.png | srcset c.png"),
    ('<picture><source srcset="w.webp"><img src="w.jpg"></picture><img src="w.jpg">', "img w.jpg | srcset w.webp"), ("<p>x</p>", ""), (None, None),
], ["assets"])

_cases("cases_login_page", "html string", lambda: [markup.login_page(F.col("html"))], [
    ("<h1>Sign In</h1><input name=username><input type=PASSWORD>", True), ("password username", False), ("用户登录 password", True), ("", False), (None, False),
], ["login"])

_CODE = """config = { "url": "/conf/a" }; xhr.open("GET", "/x/1"); $.getJSON("data.json"); axios.post("/api/v1/p", {data: {name: 'n', 'k': "v"}}); fetch("https://q.com/z"); `hello/${x}/there`; h = "/p.php?id=1";"""
_SITE = "http://a.com"
_cases("cases_script_addresses", "text string", lambda: [
    _text(scripts.object_addresses(F.col("text"), F.lit(_SITE))), _text(scripts.request_addresses(F.col("text"), F.lit(_SITE))),
    _text(scripts.endpoints(F.col("text"))), _text(scripts.code_addresses(F.col("text"))),
], [
    (_CODE, "http://a.com/conf/a | http://a.com/there", "http://a.com/x/1 | https://q.com/z | http://a.com/api/v1/p", "/api/v1/p | /p.php?id=1 | /x/1", "https://q.com/z | /api/v1/p | /x/1"),
    ("API_BASE = '/base/1'; ENDPOINT: '/img/a.png'; path: '/77'; path: '/a{b}[c]'", "http://a.com/base/1", "", "", ""),
    ("xhr.send('/s'); window.open('/w/x'); redirect('/only')", "", "http://a.com/s", "", "/w/x"), ("", "", "", "", ""), (None, None, None, None, None),
], ["objects", "requests", "endpoints", "code"])

_cases("cases_routes", "text string", lambda: [_text(scripts.route_addresses(F.col("text"), F.lit(_SITE))), _text(scripts.coded_addresses(F.col("text")))], [
    ("path: '/user/:id', route: \"about\", <Route path='/r/*'>", "http://a.com/user/1 | http://a.com/about | http://a.com/r/", ""),
    ("routes = [A, B]", "http://a.com/A, B", ""), ("path: '*'", "", ""),
    ("x = atob('L2FwaS9zZWNyZXQvcGF0aA=='); atob(\"L2FwaS9zZWNyZXQvcGF0aA\")", "", "/api/secret/path"),
    ("window.atob('aHR0cHM6Ly9hLmNvbS94')", "", "https://a.com/x"), ("atob('AAAAAAAAAAAAAAAAA')", "", ""), ("atob('bm8gYWRkcmVzcyBoZXJl')", "", ""), (None, None, None),
], ["routes", "coded"])

_cases("cases_nearby_parameters", "text string, found string", lambda: [_pairs(scripts.nearby_parameters(F.col("text"), F.col("found")), "name", "value")], [
    ("$.post('/save', {data: {name: 'n', 'k': \"v\", n: 3}})", "/save", "name n | k v | n 3"), ("$.post('/save')", "/save", ""), ("data: {a: 1}", "/other", ""),
    ("'/save'" + " " * 300 + "data: {a: 1}", "/save", ""), ("data: {a: 1}" + " " * 150 + "'/save'", "/save", "a 1"), (None, "/x", ""),
], ["members"])


def _shown(version: bool = True):
    found = technology.detected(F.col("html"), F.from_json("headers", "map<string,string>"), F.col("url"))
    return _pairs(found, "name", "confidence", "version") if version else _text(technology.summary(found))


_cases("cases_technologies", "html string, headers string, url string", lambda: [_shown(), _shown(False)], [
    ('<meta name="generator" content="WordPress 6.2"> /wp-content/', '{"server": "nginx/1.18.0"}', "http://a/wp-admin/", "WordPress 80 6.2 | Nginx 30 1.18.0", "WordPress 6.2 | Nginx 1.18.0"),
    ("/wp-content/", None, None, "", ""), ("/wp-content/ wordpress", None, None, "WordPress 40 ", "WordPress"),
    ("", '{"Set-Cookie": "laravel_session=a; XSRF-TOKEN=b"}', None, "Laravel 80 ", "Laravel"),
    ("", '{"Set-Cookie": "sessionid=1"}', None, "", ""), ("", '{"X-Powered-By": "PHP/8.1.2"}', "http://a/x.php", "PHP 50 8.1.2", "PHP 8.1.2"),
    ("new Vue({}) vue@3.2.1 vue.js v-if", None, None, "Vue.js 70 3.2.1", "Vue.js 3.2.1"),
    ('<div id="root"></div> react.js react-dom.js data-reactroot React.createElement ReactDOM.render', None, None, "React 100 ", "React"),
    (None, None, None, "", ""), ("", '{"X-Powered-By": "Express"}', None, "Node.js 30  | Express 30 ", "Node.js | Express"),
], ["found", "named"])

_cases("cases_by_type", "url string", lambda: [filters.by_type(F.col("url"), filters.preset("balanced", "a.com"))["reason"], filters.by_type(F.col("url"), filters.preset("balanced", "a.com"))["score"].cast("int")], [
    ("http://a.com/x", "page", 80), ("http://a.com/x.js?v=1", "js", 85), ("http://a.com/x.css", "css", 50), ("http://a.com/x.PNG", "static", 20),
    ("http://a.com/x.php", "dynamic", 90), ("http://a.com/x.htm", "dynamic", 90), ("http://a.com/x.zzz", "unknown", 70), ("http://a.com/x.", "page", 80), ("http://a.com/a.b/c", "unknown", 70),
], ["reason", "score"])

_cases("cases_prepared_scopes", "url string", lambda: [F.coalesce(pipelines.scope_reason(F.col("url"), pipelines.prepared_scope(k, "a.com")), F.lit("")) for k in ("api", "admin", "static")], [
    ("http://a.com/api/x", "", "path", ""), ("http://a.com/v1/x.css", "extension", "path", "extension"), ("http://a.com/admin/logout", "path", "excluded path", ""),
    ("http://a.com/manage/u", "path", "", ""), ("http://b.com/api/x", "host", "host", "host"), ("http://a.com/x.woff2", "path", "path", "extension"),
], ["api", "admin", "static"])

_cases("cases_findings", "tagged string", lambda: [reports.findings(F.col("tagged"))["kind"], reports.findings(F.col("tagged"))["url"]], [
    ("ADMIN_PATH: http://a.com/x", "ADMIN_PATH", "http://a.com/x"), ("http://a.com/: x", "", "http://a.com/: x"), ("", "", ""), (None, None, None),
], ["kind", "url"])

_FEATURE = "struct<depth:int,nodes:int,links:int,forms:int,inputs:int>"
_cases("cases_feature_similarity", f"a {_FEATURE}, b {_FEATURE}", lambda: [F.round(trees.feature_similarity(F.col("a"), F.col("b")), 6)], [
    ((3, 10, 0, 0, 0), (3, 10, 0, 0, 0), 1.0), ((4, 10, 2, 0, 0), (2, 5, 0, 0, 0), 0.6), ((0, 0, 0, 0, 0), (0, 0, 0, 0, 0), 1.0), ((1, 1, 1, 1, 1), (0, 0, 0, 0, 0), 0.0),
], ["similarity"])

_cases("cases_page_worth", "links int, apis int, forms int, status int", lambda: [reports.page_worth(*[F.col(c) for c in ("links", "apis", "forms", "status")])], [
    (0, 0, 0, 200, 55.0), (11, 1, 1, 200, 100.0), (6, 0, 0, 302, 55.0), (10, 1, 0, 500, 55.0), (0, 0, 0, 404, 30.0), (None, None, None, None, 50.0),
], ["worth"])


def learned_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers: 50 failed pages, 30 good ones with APIs, 20 plain ones."""
    pages = [(1, 0, 0, 0, 404)] * 50 + [(2, 12, 2, 0, 200)] * 30 + [(3, 0, 0, 0, 200)] * 20
    out = reports.learned_weights(spark.createDataFrame(pages, "layer int, links int, apis int, forms int, status int"))
    return out.select("layer", "pages", "changed", *[F.round(c, 6).alias(c) for c in ("high_rate", "api_rate", "success_rate", "depth", "internal", "params", "path_value")])


# Layer 1: no page of high worth, all of low: depth 3 * 0.925, internal 2 * 1.12, path_value 4 * 1.15. Layer 2 ends at 80.
# Layer 3: 30 of 100 of high worth, 50 % of low (not over), 0.6 APIs a page: params 1.5 * 1.15; success 0.5: internal again.
_rows("cases_learned_weights", learned_cases, ["layer", "pages", "changed", "high_rate", "api_rate", "success_rate", "depth", "internal", "params", "path_value"], [
    (1, 50, True, 0.0, 0.0, 0.0, 2.775, 2.24, 1.5, 4.6), (2, 80, False, 0.375, 0.75, 0.375, 2.775, 2.24, 1.5, 4.6),
    (3, 100, True, 0.3, 0.6, 0.5, 2.775, 2.5088, 1.725, 4.6),
])


def captured_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal requests: those of the domain without refused parts, counted by host, method and in all."""
    log = spark.createDataFrame([("GET", "http://a.com/x"), ("POST", "http://api.a.com/y"), ("GET", "http://b.org/a.com"), ("GET", "http://a.com/ping"), ("GET", None)], "method string, url string")
    kept = reports.captured_requests(log, "a.com", ["/ping"])
    return reports.capture_counts(kept, F.regexp_extract("url", "//([^/]*)", 1), F.col("method"))


_rows("cases_captured", captured_cases, ["host", "method", "n"], [("a.com", None, 1), ("api.a.com", None, 1), (None, "GET", 1), (None, "POST", 1), (None, None, 2)])


def state_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "url string")
    return reports.progress(reports.with_state(one("a", "b", "c", "c", None), one("a", "z"), one("b", "a")))


_rows("cases_crawl_state", state_cases, ["visited", "failed", "pending", "percent"], [(2, 1, 1, 50.0)])


def script_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["http://www.a.com/x.js", "http://cdn.a.com/x.js", "http://cdn.a.com/x.js", "http://cdn.a.com/x.css", "http://b.org/y.JS", "http://cdnjs.cloudflare.com/z.js", "/local.js", None]
    return markup.foreign_scripts(spark.createDataFrame([(x,) for x in rows], "url string"), "www.a.com")


_rows("cases_foreign_scripts", script_cases, ["url", "reason"], [("http://cdn.a.com/x.js", "cdn"), ("http://cdnjs.cloudflare.com/z.js", "cdn")])


def login_repeat_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, f"http://a.com/login?n={i}") for i in range(6)] + [(10, "http://a.com/x"), (11, "http://a.com/x"), (12, None), (13, "http://b.com/login")]
    return markup.without_login_repeats(spark.createDataFrame(rows, "id int, url string"), "url", ["id"]).select("id")


_rows("cases_login_repeats", login_repeat_cases, ["id"], [(i,) for i in (0, 1, 2, 3, 10, 11, 12, 13)])


def leader_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain 1-2-3-4, a pair 5-6 that both are similar to 1, a page alone, and a pair of unknown ids."""
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 9, 9, None)], "id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (3, 4), (1, 5), (5, 6), (0, 9)], "a long, b long")
    return trees.leaders(nodes, pairs)


_rows("cases_leaders", leader_cases, ["id", "leader", "kept"], [(1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False), (5, 1, False), (6, 6, True), (9, 9, True)])


def similar_report_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.createDataFrame([("u1", "k", 0.9), ("u2", "k", 1.0), ("u3", "k", 0.86)], "url string, similar_to string, similarity double")
    return trees.similar_report(found, 7, most=2)


_rows("cases_similar_report", similar_report_cases, ["report"], [("threshold 85.0%, pages 7, similar 3, saved 30.0%\n100.0% u2 like k\n90.0% u1 like k\nand 1 more",)])


def page_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of technologies over whole pages."""
    return technology.technologies(table(spark, sf_dir, "pages"), url="url")


def page_link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links of each kind the pages have."""
    return table(spark, sf_dir, "pages").select("page_id", F.inline(markup.page_links(F.col("html")))).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


def dom_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the distinct structures of pages stay: those unlike every one before that stayed. A structure is its first
    page; pages of one structure go the way of their first."""
    signed = similarity.signatures(table(spark, sf_dir, "pages"))
    first = signed.groupBy("struct_hash").agg(F.min("page_id").alias("id"))
    return trees.leaders(first, similarity.similar_structures(signed))


QUERIES |= {"page_technologies": page_technologies, "page_link_kinds": page_link_kinds, "dom_leaders": dom_leaders}
