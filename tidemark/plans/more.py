"""Further queries: hosts, API paths, fields, responses, embeddings, JSON profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import hosts, scores, urls
from tidemark.operators import extract, responses
from tidemark.plans.registry import DOMAIN, IN_DOMAIN, ORACLE, P, Q, QUERIES, _scalar, case_sql, query, requests, table

_scalar("api_version", hosts.api_version, "regexp_extract(lower(path),'/v(\\d+)(?:/|$)',1)")
_scalar("api_kind", hosts.api_kind, "CASE WHEN contains(lower(path),'graphql') THEN 'graphql' WHEN regexp_matches(lower(path),'/(soap|wsdl)') THEN 'soap' WHEN regexp_matches(lower(path),'/(api|rest)/|/v\\d+/') THEN 'rest' ELSE 'none' END")
_scalar("path_priority", lambda u: hosts.path_priority(u).cast("long"), "CAST(" + case_sql([(f"regexp_matches(lower(path),'{'|'.join(w)}')", str(n)) for n, w in hosts.PATH_PRIORITY], "1") + " AS BIGINT)")
_scalar("is_cdn", lambda u: hosts.is_cdn(urls.hostname(u)), "(regexp_matches(hostname,'(^|\\.)(" + "|".join(d.replace(".", "\\.") for d in hosts.CDN_DOMAINS) + ")$') OR regexp_matches(hostname,'(^|\\.)(cdn\\d*|static\\d*|assets|img\\d*)\\.'))", both=False)
_scalar("auth_redirect", hosts.auth_redirect, "(regexp_matches(lower(path),'/(login|signin|sign-in|auth|oauth|sso|cas|saml|account/login|user/login|passport)(/|\\.|$)') OR regexp_matches(hostname,'^(login|auth|sso|passport|accounts?|id|signin)\\.'))", both=False)
_scalar("operation_id", lambda u: F.lower(hosts.operation_id("GET", u)), "lower('get'||array_to_string(list_transform(list_filter(seg, lambda s: NOT regexp_matches(s,'^\\d+$')), lambda s: regexp_replace(s,'[^A-Za-z0-9]+','','g')),''))")


@query(f"{Q}, s AS (SELECT regexp_replace(unnest(seg),'\\d+','{{id}}','g') AS segment FROM k) SELECT segment, count(*) AS n FROM s GROUP BY 1")
def path_vocabulary(spark, sf_dir):
    return hosts.vocabulary(requests(spark, sf_dir), "url")


_IP = "CASE user_id % 4 WHEN 0 THEN '10.0.' WHEN 1 THEN '192.168.' WHEN 2 THEN '8.8.' ELSE 'h' END || (user_id % 200) || '.' || (event_id % 250)"


@query(f"WITH h AS (SELECT {_IP} AS host FROM events), c AS (SELECT host, CASE WHEN regexp_matches(host,'^(10|192\\.168)\\.') THEN 'private' WHEN regexp_matches(host,'^8\\.8\\.') THEN 'public' ELSE 'name' END AS class FROM h) SELECT class, count(*) AS n, count(DISTINCT host) AS hosts FROM c GROUP BY class")
def ip_classes(spark, sf_dir):
    h = table(spark, sf_dir, "events").select(F.expr(_IP).alias("host"))
    return h.groupBy(hosts.ip_class(F.col("host")).alias("class")).agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))


@query("SELECT page_id, array_to_string([len(regexp_extract_all(html, p)) FOR p IN ['<div','<a ','<p','<form','<input','<script','<table','<img','<li']], ',') AS features FROM pages")
def page_features(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(responses.page_features(F.col("html")).cast("array<string>"), ",").alias("features"))


@query(None)
def page_best_match(spark, sf_dir):
    v = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), responses.page_embedding("html").alias("v"))
    return responses.best_match(v)


@query("SELECT k AS name, count(*) AS n, min(CAST(json_extract_string(props, '$.'||k) AS BIGINT)) AS low, max(CAST(json_extract_string(props, '$.'||k) AS BIGINT)) AS high FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def json_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,long>")).alias("k", "v"))
    return e.groupBy(F.col("k").alias("name")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("SELECT md5('POST|/'||event_type||'|'||'id='||(user_id % 5)||'&t='||event_type) AS key, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def dedup_requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = F.create_map(F.lit("t"), F.col("event_type"), F.lit("id"), (F.col("user_id") % 5).cast("string"))
    return e.groupBy(responses.request_key(F.lit("post"), F.concat(F.lit("/"), "event_type"), p).alias("key")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("WITH f AS (SELECT event_id, user_id, ts, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS alike FROM events), i AS (SELECT *, sum(CASE WHEN alike THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) - 1 AS run FROM i), d AS (SELECT *, coalesce(sum(CASE WHEN run>=3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS done FROM r) SELECT event_id FROM d WHERE done=0")
def stop_when_alike(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    e = e.withColumn("alike", F.coalesce(F.col("event_type") == F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(False)))
    return responses.until_alike(e, "user_id", ["ts", "event_id"], F.col("alike")).select("event_id")


@query("WITH l AS (SELECT page_id, len(regexp_extract_all(html,'(?i)<a\\b[^>]*href')) AS links, len(regexp_extract_all(html,'(?i)<form\\b')) AS forms, len(regexp_extract_all(html,'/api/')) AS apis FROM pages) SELECT page_id, CAST(greatest(0, least(100, 50 + CASE WHEN apis>0 THEN 20 ELSE 0 END + CASE WHEN forms>0 THEN 15 ELSE 0 END + CASE WHEN links>10 THEN 10 WHEN links>0 THEN 5 ELSE 0 END + 5)) AS BIGINT) AS worth FROM l")
def page_worth(spark, sf_dir):
    h = F.col("html")
    n = lambda p: F.regexp_count(h, F.lit(p))
    return table(spark, sf_dir, "pages").select("page_id", responses.page_value(n(r"(?i)<a\b[^>]*href"), n(r"(?i)<form\b"), n("/api/"), F.lit(200)).cast("long").alias("worth"))


@query(f"{P}, n AS (SELECT DISTINCT page_id, unnest(list_concat(regexp_extract_all(url,'[?&]([A-Za-z0-9_\\-]+)=',1), regexp_extract_all(html,'[?&]([A-Za-z0-9_\\-]+)=',1), regexp_extract_all(html,'(?i)<(?:input|select|textarea)\\b[^>]*?\\bname\\s*=\\s*[\"'']([^\"'']+)[\"'']',1))) AS name FROM pages) SELECT page_id, name FROM n")
def parameter_names(spark, sf_dir):
    return responses.parameter_names(table(spark, sf_dir, "pages"))


@query(None)
def parameter_variants(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", F.explode(hosts.parameter_variants(F.col("url"))).alias("variant"))


@query(f"{P} SELECT count(*) AS pages, count(DISTINCT hostname) AS hosts, count(DISTINCT scheme||host||path) AS addresses, CAST(sum(CASE WHEN {IN_DOMAIN} THEN 1 ELSE 0 END) AS BIGINT) AS in_scope, round(avg(CASE WHEN query<>'' THEN 1.0 ELSE 0.0 END),6) AS with_query FROM k")
def run_totals(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").agg(
        F.count("*").alias("pages"), F.count_distinct(urls.hostname(u)).alias("hosts"), F.count_distinct(F.concat(urls.scheme(u), urls.host(u), urls.path(u))).alias("addresses"),
        F.sum(urls.in_domain(urls.hostname(u), DOMAIN).cast("long")).alias("in_scope"), F.round(F.avg((urls.query(u) != "").cast("double")), 6).alias("with_query"),
    )


@query("SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html,'(?is)<(script|style)\\b.*?</(script|style)>',' ','g'),'<[^>]*>',' ','g'),'\\s+',' ','g'))) AS characters FROM pages")
def visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(extract.visible_text(F.col("html"))).cast("long").alias("characters"))


@query(f"{Q} SELECT CASE WHEN ext='' THEN 'page' ELSE ext END AS kind, count(*) AS n, count(DISTINCT url) AS addresses FROM k GROUP BY 1")
def asset_kinds(spark, sf_dir):
    e = urls.extension(F.col("url"))
    return requests(spark, sf_dir).groupBy(F.when(e == "", "page").otherwise(e).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("url").alias("addresses"))


@query(None)
def hybrid_priority(spark, sf_dir):
    u = F.col("url")
    return requests(spark, sf_dir).select("event_id", F.round(scores.priority(u, F.lit(1), DOMAIN) + scores.business_score(u) / 100 * 10, 6).alias("priority"))


__all__ = ["ORACLE", "QUERIES"]
