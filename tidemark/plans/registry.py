"""The registered queries over the shared tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scores, urls
from tidemark.operators import dedup, extract, filters, leaks, reports, similarity

DOMAIN = "example.com"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a request log with addresses."""
    e = table(spark, sf_dir, "events")
    path = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("/shop/item-"), (F.col("event_id") % 40).cast("string"), F.lit(".html")))
        .when(F.col("event_type") == "click", F.concat(F.lit("/search?q=a"), (F.col("event_id") % 9).cast("string"), F.lit("&page="), (F.col("event_id") % 5).cast("string"), F.lit("&utm_source=feed")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("/api/v1/order/"), F.col("user_id").cast("string"), F.lit("?token=ab"), (F.col("event_id") % 3).cast("string")))
        .when(F.col("event_type") == "signup", F.lit("/user/register?id=1&email=x%40y&sid=9"))
        .otherwise(F.concat(F.lit("/static/img/"), (F.col("event_id") % 11).cast("string"), F.lit(".png?file=../a")))
    )
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.concat(F.lit("https://www.example.com"), path).alias("url"))


R = """r AS (SELECT event_id, ts, user_id, event_type, value, 'https://www.example.com' || CASE
 WHEN event_type='view' THEN '/shop/item-' || (event_id % 40) || '.html'
 WHEN event_type='click' THEN '/search?q=a' || (event_id % 9) || '&page=' || (event_id % 5) || '&utm_source=feed'
 WHEN event_type='purchase' THEN '/api/v1/order/' || user_id || '?token=ab' || (event_id % 3)
 WHEN event_type='signup' THEN '/user/register?id=1&email=x%40y&sid=9'
 ELSE '/static/img/' || (event_id % 11) || '.png?file=../a' END AS url FROM events)"""


def parts(source: str) -> str:
    """CTEs u and k: the parts of the addresses of ``source``."""
    return f"""u AS (SELECT *, lower(regexp_extract(url,'^([A-Za-z][A-Za-z0-9+.-]*)://',1)) AS scheme,
 regexp_extract(url,'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)',1) AS host,
 regexp_extract(url,'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)',1) AS path,
 regexp_extract(url,'^[^?#]*\\?([^#]*)',1) AS query, regexp_extract(url,'#(.*)$',1) AS fragment FROM {source}),
k AS (SELECT *, scheme||'://'||host||path AS base, list_filter(str_split(query,'&'), lambda p: p<>'') AS pairs,
 list_sort(list_distinct(list_transform(list_filter(str_split(query,'&'), lambda p: p<>''), lambda p: split_part(p,'=',1)))) AS names,
 list_filter(str_split(path,'/'), lambda s: s<>'') AS seg, lower(regexp_replace(host, ':\\d+$', '')) AS hostname,
 lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM u)"""


P = "WITH " + parts("pages")
Q = "WITH " + R + ", " + parts("r")
PATTERN = "CASE WHEN len(names)>0 THEN base||'?'||array_to_string(names,'=&')||'=' ELSE base END"
LIMITER = "CASE WHEN len(names)>0 THEN base||'?'||array_to_string(names,'&')||'=' ELSE base END"


def lst(words) -> str:
    return "(" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def case_sql(cases, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END"


def _scalar(name: str, f: Callable[[Column], Column], sql: str, both: bool = True) -> None:
    """A URL function over the pages and over the request log."""

    def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "pages").select("page_id", f(F.col("url")).alias("result"))

    def log(spark: SparkSession, sf_dir: str) -> DataFrame:
        return requests(spark, sf_dir).select("event_id", f(F.col("url")).alias("result"))

    QUERIES[f"url_{name}"] = log
    ORACLE[f"url_{name}"] = f"{Q} SELECT event_id, {sql} AS result FROM k"
    if both:
        QUERIES[f"page_url_{name}"] = pages
        ORACLE[f"page_url_{name}"] = f"{P} SELECT page_id, {sql} AS result FROM k"


SEGMENT = """CASE WHEN regexp_matches(s,'^\\d+$') THEN '{num}'
 WHEN regexp_matches(lower(s),'^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$') THEN '{uuid}'
 WHEN regexp_matches(lower(s),'^[a-f0-9]{16,}$') THEN '{hash}'
 WHEN regexp_matches(s,'^.+?[-_]\\d+(\\.\\w+)?$') THEN regexp_replace(s,'^(.+?)([-_])(\\d+)(\\.\\w+)?$','\\1\\2{num}\\4')
 WHEN regexp_matches(s,'^[a-zA-Z]+\\d+$') THEN regexp_replace(s,'\\d+$','{num}')
 WHEN regexp_matches(s,'^\\d+[a-zA-Z]+$') THEN regexp_replace(s,'^\\d+','{num}') ELSE s END"""
STRUCT_PATH = f"""CASE WHEN path IN ('','/') THEN path ELSE '/'||array_to_string(list_transform(seg, lambda s: {SEGMENT}),'/') || CASE WHEN path LIKE '%/' THEN '/' ELSE '' END END"""
KEPT = "list_sort(list_filter(pairs, lambda p: split_part(p,'=',1) NOT IN {}))"

_scalar("param_pattern", urls.param_pattern, PATTERN)
_scalar("limiter_pattern", urls.limiter_pattern, LIMITER)
_scalar("method_pattern", urls.method_pattern, f"'GET:'||({PATTERN})||CASE WHEN fragment<>'' THEN '#'||fragment ELSE '' END")
_scalar("structure", urls.structure, f"scheme||'://'||host||({STRUCT_PATH})||CASE WHEN len(names)>0 THEN '?'||array_to_string(names,'=&')||'=' ELSE '' END")
_scalar("exact_key", urls.exact_key, "md5(CASE WHEN len(pairs)>0 THEN base||'?'||array_to_string(list_sort(pairs),'&') ELSE base END)")
_CANON = "scheme||'://'||regexp_replace(regexp_replace(lower(host),':80$',''),':443$','')||regexp_replace(regexp_replace(path,'/+','/','g'),'/$','')"
_KT, _KS = KEPT.format(lst(urls.TRACKING)), KEPT.format(lst(urls.SESSION))
_scalar("canonical", urls.canonical, f"CASE WHEN len({_KT})>0 THEN {_CANON}||'?'||array_to_string({_KT},'&') ELSE {_CANON} END")
_scalar("without_session", urls.without_session, f"CASE WHEN len({_KS})>0 THEN base||'?'||array_to_string({_KS},'&') ELSE base END")
_SIMILAR = "regexp_replace(regexp_replace(regexp_replace(path,'\\d+','{num}','g'),'([-_])\\{num\\}','\\1{id}','g'),'/\\{num\\}/','/{id}/','g')"
_scalar("similar_pattern", urls.similar_pattern, f"scheme||'://'||host||{_SIMILAR}||CASE WHEN len(names)>0 THEN '?'||array_to_string(names,'=&')||'=' ELSE '' END")
_scalar("main_domain", urls.main_domain, "array_to_string(list_slice(str_split(hostname,'.'),-2,-1),'.')")
_scalar("base_domain", urls.base_domain, "CASE WHEN regexp_matches(hostname,'\\.(com|net|org|gov|edu|co|ac|ne|or)\\.(cn|jp)$') THEN array_to_string(list_slice(str_split(hostname,'.'),-3,-1),'.') ELSE array_to_string(list_slice(str_split(hostname,'.'),-2,-1),'.') END")
_scalar("both_schemes", lambda u: F.array_join(urls.both_schemes(u), " "), "CASE WHEN scheme IN ('http','https') THEN 'http://'||regexp_replace(url,'^[A-Za-z]+://','')||' https://'||regexp_replace(url,'^[A-Za-z]+://','') ELSE url END")
STATIC = [e for v in scores.EXTENSIONS.values() for e in v]
LIMITER_STATIC = [e for e in STATIC if e not in ("mjs", "wav", "ogg")]
LIMITER_TYPE = case_sql([
    ("ext IN ('jpg','png','gif','svg')", "'image'"), (f"ext IN {lst(LIMITER_STATIC)}", "'static'"),
    (any_sql("lower(path)", ["api", "ajax", "/v1/", "/v2/"]), "'api'"), (any_sql("lower(path)", ["login", "register", "signup", "form", "submit"]), "'form'"),
], "'normal'")
_scalar("limiter_type", scores.limiter_type, LIMITER_TYPE)
IN_DOMAIN = f"(hostname='{DOMAIN}' OR hostname LIKE '%.{DOMAIN}')"
RESOURCE = case_sql(
    [(f"host<>'' AND NOT {IN_DOMAIN}", "'external'")]
    + [(f"ext IN {lst(scores.EXTENSIONS[x])}", f"'{x}'") for x in ("javascript", "css")]
    + [(any_sql("lower(path)", ["/api/", "/rest/", "/graphql", "/v1/", "/v2/", "/v3/"]) + " OR ext IN ('json','xml')", "'api'")]
    + [(f"ext IN {lst(scores.EXTENSIONS[x])}", f"'{x}'") for x in ("image", "video", "audio", "font", "document", "archive")], "'page'")
_scalar("resource_type", lambda u: scores.resource_type(u, DOMAIN), RESOURCE)
_RESNAME = "(regexp_matches({0},'^[A-Za-z]') AND length({0})>=2 AND length(regexp_replace({0},'[^A-Za-z]','','g'))/length({0})>0.6)"
URL_TYPE = case_sql([
    ("regexp_matches(lower(url), '\\.(" + "|".join(STATIC) + ")(\\?|$)')", "'StaticAsset'"),
    (any_sql("lower(url)", ["/ajax/", "/api/", "/rest/", "/graphql", "/v1/", "/v2/", "/v3/", ".json", ".xml", ".api"]), "'AJAX'"),
    ("len(list_filter(names, lambda n: " + any_sql("lower(n)", ["file", "path", "doc", "download", "upload"]) + "))>0", "'FileParam'"),
    (f"len(list_filter(range(1, len(seg)), lambda i: {_RESNAME.format('seg[i]')} AND regexp_matches(seg[i+1],'\\d')))>0 OR len(list_filter(seg, lambda s: contains(s,'-') AND regexp_matches(s,'\\d')))>0", "'RESTful'"),
    ("len(names)>=2", "'MultiParam'"),
], "'Normal'")
_scalar("type", scores.url_type, URL_TYPE)
BTEXT = "lower(array_to_string(seg,'/')||' '||array_to_string(names,' '))"
BTYPE = case_sql([(any_sql(BTEXT, w), f"'{n}'") for n, w in scores.BUSINESS_TYPES] + [("len(names)=0 AND len(seg)<=2", "'simple_page'"), ("len(names)>=3", "'complex_query'")], "'unknown'")
_scalar("business_type", scores.business_type, BTYPE)
_PBONUS = case_sql([(f"lower(n)='{a}'", f"{b}.0") for a, b in scores.PARAM_SCORES.items()], "0.0")
BSCORE = f"""CAST(least(100.0, greatest(0.0, ({case_sql([(f"({BTYPE})='{a}'", f"{b}.0") for a, b in scores.TYPE_SCORES.items()], "0.0")})
 + coalesce(list_sum(list_transform(names, lambda n: CAST({_PBONUS} + CASE WHEN contains(lower(n),'admin') OR contains(lower(n),'auth') THEN 8.0 ELSE 0.0 END AS DOUBLE))),0)
 + CASE WHEN len(seg) BETWEEN 3 AND 5 THEN 5.0 WHEN len(seg)>6 THEN -3.0 ELSE 0.0 END
 + CASE WHEN len(names)=1 THEN 3.0 WHEN len(names) BETWEEN 2 AND 4 THEN 5.0 WHEN len(names)>8 THEN -5.0 ELSE 0.0 END
 + CASE WHEN len(seg)>=2 AND (len(list_filter(seg, lambda s: {any_sql('lower(s)', ['api', 'v1', 'v2', 'v3', 'rest'])}))>0 OR regexp_matches(seg[-1],'^\\d+$|^[0-9a-f]{{8}}-[0-9a-f]{{4}}')) THEN 8.0 ELSE 0.0 END
 + CASE WHEN regexp_matches(lower(array_to_string(seg,'/')),'(create|update|delete|edit|modify|remove)') THEN 10.0 ELSE 0.0 END
 + CASE WHEN regexp_matches(lower(array_to_string(seg,'/')),'(config|setting|permission|role|privilege)') THEN 12.0 ELSE 0.0 END)) AS DOUBLE)"""
_scalar("business_score", scores.business_score, BSCORE)
CSCORE = ("CAST(least(100.0, greatest(0.0, 50.0" + "".join(f" + CASE WHEN contains(lower(url),'{w}') THEN {s}.0 ELSE 0.0 END" for w, s in scores.VALUE_WORDS.items())
    + " + CASE WHEN contains(url,'?') THEN CASE WHEN len(str_split(url,'='))-1=1 THEN 5.0 WHEN len(str_split(url,'='))-1 BETWEEN 2 AND 4 THEN 10.0 ELSE 0.0 END ELSE 0.0 END + CASE WHEN regexp_matches(url,'/\\d+/?$') THEN 10.0 ELSE 0.0 END"
    + "".join(f" - CASE WHEN contains(lower(url),'{w}') THEN 15.0 ELSE 0.0 END" for w in scores.LOW_VALUE_WORDS) + ")) AS DOUBLE)")
_scalar("chain_score", scores.chain_score, CSCORE)
PVALUE = case_sql([(any_sql("lower(path)", w), str(v)) for v, w in scores.PATH_TIERS] + [(any_sql("lower(path)", [".jpg", ".png", ".gif", ".css", ".woff", ".svg"]), "0.3")], "0.5")
PRIORITY = f"CAST(round(3.0/2 + CASE WHEN {IN_DOMAIN} THEN 2.0 ELSE 0.0 END + CASE WHEN query<>'' THEN CASE WHEN len(names)>=3 THEN 3.0 WHEN len(names)>=2 THEN 2.25 ELSE 1.5 END ELSE 0.0 END + 0.5 + 4.0*({PVALUE}),6) AS DOUBLE)"
_scalar("priority", lambda u: F.round(scores.priority(u, F.lit(2), DOMAIN), 6), PRIORITY)
LOGIN = any_sql("lower(url)", ["/login", "/signin", "/auth/", "/account/login", "/user/login", "/sso/", "/oauth/", "login.php", "signin.php", "auth.php"])
_scalar("is_login", filters.login_url, LOGIN, both=False)
_scalar("in_domain", lambda u: urls.in_domain(urls.hostname(u), DOMAIN), IN_DOMAIN)
VCLASS = case_sql([
    ("v=''", "'empty'"), ("regexp_matches(lower(v),'^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')", "'uuid'"),
    ("regexp_matches(lower(v),'^[a-f0-9]{32}$')", "'md5'"), ("regexp_matches(lower(v),'^[a-f0-9]{40}$')", "'sha1'"), ("regexp_matches(lower(v),'^[a-f0-9]{64}$')", "'sha256'"),
    ("contains(v,'../') OR contains(v,'..\\') OR contains(v,'..%2F')", "'path_traversal'"),
    ("regexp_matches(v,'^[A-Za-z0-9+/]+=*$') AND length(v)>10", "'base64'"), ("regexp_matches(v,'^[0-9a-fA-F]+$') AND length(v)>6", "'hex'"),
    ("regexp_matches(v,'^\\d+$')", "CASE WHEN length(v)<=5 THEN 'num_1_5' WHEN length(v)<=10 THEN 'num_6_10' WHEN length(v)<=20 THEN 'num_11_20' ELSE 'num_20+' END"),
    ("regexp_matches(v,'^[a-zA-Z]+$')", "CASE WHEN length(v)<=5 THEN 'alpha_1_5' WHEN length(v)<=10 THEN 'alpha_6_10' ELSE 'alpha_11+' END"),
    ("regexp_matches(v,'^[a-zA-Z0-9]+$')", "'alphanum'"),
], "'special'")
VALUES = "SELECT doc_id, unnest(str_split(left(text, 1000000000), ' ')) AS v FROM documents"


@query(f"SELECT class, count(*) AS n FROM (SELECT {VCLASS} AS class FROM ({VALUES})) GROUP BY class")
def value_classes(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("v"))
    words = v.groupBy("v").agg(F.count("*").alias("n"))  # each distinct word is classed once
    return words.groupBy(scores.value_class(F.col("v")).alias("class")).agg(F.sum("n").alias("n"))


@query(f"{P}, c AS (SELECT page_id, page_id % 3 AS g, url, {CSCORE} AS s, scheme, hostname, ext FROM k) SELECT page_id, CASE WHEN NOT (hostname='{DOMAIN}' OR hostname LIKE '%.{DOMAIN}') THEN 'degrade' WHEN regexp_matches(url,'#[0-9A-Fa-f]{{3,8}}$') THEN 'reject' WHEN s<30 THEN 'reject' ELSE 'allow' END AS action FROM c")
def filter_chain(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", filters.judge(F.col("url"), filters.preset("balanced", DOMAIN))["action"].alias("action"))


@query(None)
def filter_explain(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(filters.explain(F.col("url"), filters.preset("strict", DOMAIN))).alias("s")).select("page_id", "s.*")


@query(f"{P}, c AS (SELECT {CSCORE} AS s, hostname, url FROM k) SELECT 'Scope' AS stage, count(*) AS n FROM c WHERE NOT (hostname='{DOMAIN}' OR hostname LIKE '%.{DOMAIN}') UNION ALL SELECT 'value', count(*) FROM c WHERE (hostname='{DOMAIN}' OR hostname LIKE '%.{DOMAIN}') AND s>=40")
def filter_statistics(spark, sf_dir):
    v = filters.judge(F.col("url"), filters.preset("strict", DOMAIN))
    p = table(spark, sf_dir, "pages").select(v["reason"].alias("reason"))
    named = p.select(F.when(F.col("reason") == "outside scope", "Scope").when(F.col("reason") == "value", "value").alias("stage")).where("stage is not null")
    return named.groupBy("stage").agg(F.count("*").alias("n"))


@query(f"{P} SELECT page_id, url FROM k WHERE hostname LIKE '%.example.org' OR hostname='example.org'")
def scope_join(spark, sf_dir):
    allowed = spark.createDataFrame([("example.org",), ("example.com",)], "domain string")
    denied = spark.createDataFrame([("example.com",)], "domain string")
    return filters.scope_filter(table(spark, sf_dir, "pages").select("page_id", "url"), "url", allowed, denied)


@query(f"{Q}, d AS (SELECT *, {PATTERN} AS p, row_number() OVER (PARTITION BY {PATTERN} ORDER BY ts, event_id) AS n FROM k) SELECT event_id, url FROM d WHERE n=1")
def dedup_first_of_pattern(spark, sf_dir):
    r = requests(spark, sf_dir).select("ts", "event_id", "url")
    return dedup.first_seen(r, urls.param_pattern(F.col("url")), ["ts", "event_id"]).select("event_id", "url")


@query(f"{Q}, d AS (SELECT *, row_number() OVER (PARTITION BY scheme||'://'||host||({STRUCT_PATH})||array_to_string(names,'=&') ORDER BY ts, event_id) AS n FROM k) SELECT event_id, url FROM d WHERE n=1")
def dedup_first_of_structure(spark, sf_dir):
    r = requests(spark, sf_dir).select("ts", "event_id", "url")
    return dedup.first_seen(r, urls.structure(F.col("url")), ["ts", "event_id"]).select("event_id", "url")


@query("WITH " + R + " SELECT event_id, first_value(event_id) OVER (PARTITION BY url ORDER BY ts, event_id) AS original, first_value(event_id) OVER (PARTITION BY url ORDER BY ts, event_id) <> event_id AS is_duplicate FROM r")
def dedup_exact(spark, sf_dir):
    r = requests(spark, sf_dir).select("ts", "event_id", "url")
    return dedup.mark_duplicates(r, F.col("url"), ["ts"], "event_id").select("event_id", "original", "is_duplicate")


@query("SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text")
def dedup_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(f"{Q}, d AS (SELECT {PATTERN} AS key, url, count(*) AS c FROM k GROUP BY 1, 2) SELECT key, CAST(sum(c) AS BIGINT) AS n, count(*) AS variants, array_to_string(list_slice(list_sort(list(url)),1,5),' ') AS samples FROM d GROUP BY key")
def pattern_groups(spark, sf_dir):
    return dedup.groups(requests(spark, sf_dir), urls.param_pattern(F.col("url")), "url").withColumn("samples", F.array_join("samples", " "))


@query(f"{Q}, t AS (SELECT *, {LIMITER} AS p, {LIMITER_TYPE} AS kind FROM k), d AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY ts, event_id) AS n FROM t) SELECT event_id, kind FROM d WHERE n <= CASE kind WHEN 'api' THEN 5 WHEN 'form' THEN 5 WHEN 'image' THEN 2 WHEN 'static' THEN 1 ELSE 3 END")
def cap_by_type(spark, sf_dir):
    u = F.col("url")
    r = requests(spark, sf_dir).withColumn("kind", scores.limiter_type(u))
    return dedup.capped(r, [urls.limiter_pattern(u)], ["ts", "event_id"], dedup.type_limit(F.col("kind")), max(dedup.TYPE_LIMITS.values())).select("event_id", "kind")


_FIRST = "regexp_extract(list_filter(pairs, lambda p: split_part(p,'=',1)=n)[1],'^[^=]*=?(.*)$',1)"


@query(
    f"{Q}, v AS (SELECT *, array_to_string(list_transform(names, lambda n: url_decode({_FIRST})),'|') AS v FROM k), c AS (SELECT *, {VCLASS} AS class FROM v), "
    "d AS (SELECT *, row_number() OVER (PARTITION BY base||'?'||array_to_string(names,'&'), class ORDER BY ts, event_id) AS n FROM c) "
    "SELECT event_id, CASE WHEN v='' THEN '' ELSE class END AS class FROM d WHERE n<=3 OR v=''"
)
def cap_by_value_class(spark, sf_dir):
    """Three rows of a pattern for each class of its joined values; rows without values all pass."""
    u = F.col("url")
    r = requests(spark, sf_dir).withColumn("values", urls.joined_values(u))
    free = r.where("values = ''").select("event_id", F.lit("").alias("class"))
    r = r.where("values <> ''").withColumn("class", scores.value_class(F.col("values")))
    return dedup.capped(r, [urls.name_pattern(u), F.col("class")], ["ts", "event_id"], F.lit(3)).select("event_id", "class").unionByName(free)


@query(None)
def dedup_layered(spark, sf_dir):
    r = requests(spark, sf_dir).select("ts", "event_id", "url")
    return dedup.first_seen(r, dedup.layer_key(F.col("url")), ["ts", "event_id"]).select("event_id", "url")


@query(f"{Q}, s AS (SELECT *, {BSCORE} AS business_score, row_number() OVER (PARTITION BY path||'?'||array_to_string(names,'&') ORDER BY ts, event_id) AS nth FROM k) SELECT event_id, business_score, nth, (nth=1 OR business_score>=70 OR (business_score>=30 AND nth <= CASE WHEN business_score>=50 THEN 5 ELSE 2 END)) AS allowed FROM s")
def cap_business(spark, sf_dir):
    out = dedup.business_cap(requests(spark, sf_dir), "url", ["ts", "event_id"])
    return out.select("event_id", "business_score", F.col("nth").cast("long").alias("nth"), "allowed")


@query(f"{Q}, x AS (SELECT {PATTERN} AS pattern, unnest(pairs) AS p FROM k) SELECT pattern, split_part(p,'=',1) AS parameter, count(*) AS n, count(DISTINCT regexp_replace(p,'^[^=]*=','')) AS distinct_values FROM x GROUP BY 1, 2")
def parameter_profile(spark, sf_dir):
    return dedup.parameter_profile(requests(spark, sf_dir), "url")


@query("SELECT page_id, CAST(i AS BIGINT) AS pos, m AS link FROM (SELECT page_id, unnest(range(len(ms))) AS i, unnest(ms) AS m FROM (SELECT page_id, regexp_extract_all(html, '(?i)<(?:a|area|base)\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) AS ms FROM pages))")
def html_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    found = p.select("page_id", F.posexplode(extract.all_of(F.col("html"), extract.LINK)).alias("pos", "link"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "link")


@query(None)
def html_link_targets(spark, sf_dir):
    return extract.links(table(spark, sf_dir, "pages"))


@query(None)
def html_assets(spark, sf_dir):
    return extract.assets(table(spark, sf_dir, "pages"))


@query(None)
def html_form_requests(spark, sf_dir):
    return extract.form_requests(extract.forms(table(spark, sf_dir, "pages")))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS BIGINT) AS tags, CAST(len(list_distinct(list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: lower(t)))) AS BIGINT) AS kinds FROM pages")
def html_tag_counts(spark, sf_dir):
    t = similarity.tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(t).cast("long").alias("tags"), F.size(F.array_distinct(t)).cast("long").alias("kinds"))


@query("SELECT page_id, trim(regexp_extract(html,'(?is)<title[^>]*>(.*?)</title>',1)) AS title FROM pages")
def html_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract.title(F.col("html")).alias("title"))


@query("WITH f AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)url\\(\\s*[\"'']?([^\"'')]+)[\"'']?\\s*\\)', 1))) AS found FROM pages) SELECT page_id, found FROM f")
def css_urls(spark, sf_dir):
    return extract.text_urls(table(spark, sf_dir, "pages"), extract.CSS_URL)


@query("WITH f AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '[\"''](/[A-Za-z0-9_\\-./]+(?:\\?[^\"'']*)?)[\"'']', 1))) AS found FROM pages) SELECT page_id, found FROM f")
def js_urls(spark, sf_dir):
    return extract.text_urls(table(spark, sf_dir, "pages"), extract.JS_PATH)


@query(f"{P} SELECT DISTINCT hostname AS subdomain, CAST(len(str_split(hostname,'.'))-2 AS BIGINT) AS level FROM k WHERE hostname LIKE '%.{DOMAIN}'")
def url_subdomains(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("html", F.lit(""))
    return extract.subdomains(p, DOMAIN).withColumn("level", F.col("level").cast("long"))


@query(None)
def page_subdomains(spark, sf_dir):
    """As url_subdomains, and those that stand in the pages' texts, links and scripts."""
    return extract.subdomains(table(spark, sf_dir, "pages"), DOMAIN).withColumn("level", F.col("level").cast("long"))


TAGS = "list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: lower(t))"


@query(f"WITH t AS (SELECT page_id, {TAGS} AS ts FROM pages), h AS (SELECT page_id, ts, list_sort(list_distinct(ts)) AS ks FROM t) SELECT page_id, md5(CAST(len(ts) AS VARCHAR)||'|'||array_to_string(list_transform(ks, lambda x: x||':'||CAST(len(list_filter(ts, lambda y: y=x)) AS VARCHAR)),',')) AS struct_hash FROM h")
def dom_struct_hash(spark, sf_dir):
    return similarity.signatures(table(spark, sf_dir, "pages")).select("page_id", "struct_hash")


@query(None)
def dom_similar(spark, sf_dir):
    return similarity.similar_structures(similarity.signatures(table(spark, sf_dir, "pages")))


_W = "SELECT {0} AS id, word, count(*) AS tf FROM (SELECT {0}, regexp_replace(regexp_replace(unnest(regexp_split_to_array(lower(text), '\\s+')), '^[[:punct:]]+',''),'[[:punct:]]+$','') AS word FROM {1}) WHERE word<>'' GROUP BY 1, 2"


@query(f"WITH l AS ({_W.format('item_id', 'benchmark')}), n AS (SELECT id, sqrt(sum(tf*tf)) AS nn FROM l GROUP BY id), d AS (SELECT x.id AS a, y.id AS b, sum(x.tf*y.tf) AS dot FROM l x JOIN l y USING (word) GROUP BY 1, 2) SELECT a, b, round(dot/(p.nn*q.nn),6) AS cosine FROM d JOIN n p ON p.id=a JOIN n q ON q.id=b")
def text_cosine(spark, sf_dir):
    w = similarity.words(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return similarity.text_cosine(w, w)


_LEAKS = " UNION ALL ".join(f"SELECT id, '{n}' AS type, '{s}' AS severity, line_no, unnest(regexp_extract_all(line, '{p.replace(chr(39), chr(39) * 2)}', 0)) AS full_value, {m} AS m FROM lines" for n, p, s, m in leaks.RULES)
_LINES = "lines AS (SELECT doc_id AS id, CAST(unnest(range(1, len(l)+1)) AS BIGINT) AS line_no, unnest(l) AS line FROM (SELECT doc_id, str_split(text, chr(10)) AS l FROM documents))"
_MASK = "CASE WHEN NOT m THEN full_value WHEN length(full_value)<=8 THEN repeat('*', length(full_value)) ELSE left(full_value,4)||repeat('*', length(full_value)-8)||right(full_value,4) END"


@query(f"WITH {_LINES}, f AS ({_LEAKS}) SELECT id, type, severity, line_no, full_value, {_MASK} AS value FROM f")
def leak_scan(spark, sf_dir):
    return leaks.scan(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("line_no", F.col("line_no").cast("long"))


@query(f"WITH {_LINES}, f AS ({_LEAKS}) SELECT severity, type, count(*) AS n, count(DISTINCT id) AS sources FROM f GROUP BY GROUPING SETS ((severity), (type), ())")
def leak_summary(spark, sf_dir):
    return leaks.summary(leaks.scan(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(f"WITH {_LINES}, f AS ({_LEAKS}) SELECT DISTINCT id, type, full_value FROM f WHERE severity IN ('HIGH','MEDIUM')")
def leak_distinct(spark, sf_dir):
    found = leaks.at_least(leaks.scan(table(spark, sf_dir, "documents"), "doc_id", "text"), "MEDIUM")
    return found.select("id", "type", "full_value").distinct()


_TECH = " UNION ALL ".join(f"SELECT page_id, '{n}' AS name, '{c}' AS category, {w} AS w FROM pages WHERE regexp_matches(html, '{p}')" for n, c, _, p, w in leaks.TECHNOLOGIES)


@query(f"WITH t AS ({_TECH}) SELECT page_id, name, category, CAST(least(sum(w),100) AS BIGINT) AS confidence FROM t GROUP BY 1,2,3 HAVING sum(w)>=30")
def technologies(spark, sf_dir):
    return leaks.technologies(table(spark, sf_dir, "pages")).withColumn("confidence", F.col("confidence").cast("long"))


@query("SELECT event_type, user_id % 10 AS bucket, count(*) AS n, round(sum(value),4) AS total, CAST(floor(avg(value)) AS BIGINT) AS mean_whole FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 10), ())".replace("user_id % 10 AS bucket", "(user_id % 10) AS bucket"))
def request_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("bucket"), "value")
    return reports.grouped_counts(e, ["event_type", "bucket"], "value")


@query("WITH " + R + " SELECT url, count(*) AS n FROM r GROUP BY url ORDER BY n DESC, url LIMIT 20")
def top_urls(spark, sf_dir):
    return reports.top(requests(spark, sf_dir), ["url"], 20)


@query(f"{Q}, p AS (SELECT event_id, user_id, {PRIORITY} AS priority FROM k), d AS (SELECT *, row_number() OVER (PARTITION BY user_id % 7 ORDER BY priority DESC, event_id) AS place FROM p) SELECT user_id % 7 AS layer, event_id, priority, place FROM d WHERE place<=30")
def top_per_layer(spark, sf_dir):
    r = requests(spark, sf_dir).select((F.col("user_id") % 7).alias("layer"), "event_id", F.round(scores.priority(F.col("url"), F.lit(2), DOMAIN), 6).alias("priority"))
    return reports.top_per(r, "layer", [F.col("priority").desc(), F.col("event_id")], 30).withColumn("place", F.col("place").cast("long"))


@query("WITH " + R + " SELECT DISTINCT url FROM r WHERE event_type='view' AND url NOT IN (SELECT url FROM r WHERE user_id % 2 = 0)")
def links_not_visited(spark, sf_dir):
    r = requests(spark, sf_dir)
    return reports.except_rows(r.where("event_type = 'view'").select("url").distinct(), r.where("user_id % 2 = 0"), "url")


@query("WITH " + R + " SELECT DISTINCT url FROM r WHERE user_id % 3 = 0 AND url IN (SELECT url FROM r WHERE user_id % 2 = 0)")
def links_in_both(spark, sf_dir):
    r = requests(spark, sf_dir)
    return reports.in_both(r.where("user_id % 3 = 0").select("url").distinct(), r.where("user_id % 2 = 0"), "url")


_RUNNING = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(
    f"WITH r AS (SELECT *, count(*) {_RUNNING} AS n, sum(CASE WHEN event_type<>'error' THEN 1 ELSE 0 END) {_RUNNING} AS good, "
    f"sum(CASE WHEN event_type IN ('click','signup','purchase') THEN 1 ELSE 0 END) {_RUNNING} AS found, avg(value*100) {_RUNNING} AS ms FROM events), "
    "t AS (SELECT *, CAST((CASE WHEN good/n<0.5 THEN -10 WHEN good/n>0.9 THEN 5 ELSE 0 END) + (CASE WHEN found/n>0.5 THEN 10 WHEN found/n<0.1 THEN -5 ELSE 0 END) "
    "+ (CASE WHEN ms>5000 THEN -3 ELSE 0 END) AS DOUBLE) AS t FROM r), l AS (SELECT user_id, count(*) AS n, list(t ORDER BY ts, event_id) AS ts FROM t GROUP BY user_id) "
    "SELECT user_id, CAST(n AS INTEGER) AS n, round(list_reduce(list_prepend(0.0::DOUBLE, ts), lambda a, t: greatest(-20, least(20, a+(t-a)*0.1))),6) AS adjustment FROM l"
)
def adaptive_adjustment(spark, sf_dir):
    """The request log by user as patterns: errors fail, clicks, signups and purchases find links, forms and interfaces."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    e = reports.adaptive_target(e, "user_id", ["ts", "event_id"], F.when(kind == "error", 500).otherwise(200), F.col("value") * 100, [kind == "click", kind == "signup", kind == "purchase"])
    return reports.moving_adjustment(e, "user_id", ["ts", "event_id"], F.col("target"))


@query(None)
def request_pairing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return reports.pair_last_open(e, "user_id", ["ts", "event_id"], "event_id", F.col("event_type") == "view", F.col("event_type") == "click")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),6) AS recent_mean FROM events")
def recent_latency(spark, sf_dir):
    return reports.recent_mean(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 10).select("event_id", "recent_mean")


@query("WITH l AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation) SELECT n, 1 + (r > 0)::INT AS depth FROM l WHERE false UNION ALL SELECT DISTINCT r AS n, 0 AS depth FROM l WHERE r=0 UNION ALL SELECT n, 1 FROM l WHERE r=0 AND n NOT IN (SELECT r FROM l WHERE r=0)")
def crawl_layers(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    links = n.select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"))
    seeds = n.where("n_regionkey = 0").select(F.col("n_regionkey").alias("node"))
    return reports.layers(links, seeds, 1).select(F.col("node").alias("n"), "depth")


@query("WITH " + R + " SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM r GROUP BY 1, 2")
def hourly_requests(spark, sf_dir):
    return requests(spark, sf_dir).groupBy("event_type", F.date_trunc("hour", "ts").alias("start")).agg(F.count("*").alias("n"))


@query(f"{P}, s AS (SELECT hostname, {BSCORE} AS b FROM k) SELECT hostname, count(*) AS pages, round(avg(b),6) AS mean_score, max(b) AS best FROM s GROUP BY hostname")
def host_report(spark, sf_dir):
    u = F.col("url")
    s = table(spark, sf_dir, "pages").select(urls.hostname(u).alias("hostname"), scores.business_score(u).alias("b"))
    return s.groupBy("hostname").agg(F.count("*").alias("pages"), F.round(F.avg("b"), 6).alias("mean_score"), F.max("b").alias("best"))


@query("SELECT c.c_mktsegment AS segment, count(*) AS orders, round(sum(o.o_totalprice),2) AS total FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey GROUP BY 1")
def segment_totals(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return per.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity),2) AS sum_qty, round(sum(l_extendedprice*(1-l_discount)),2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def line_totals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("WITH m AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) SELECT o_orderkey, round(o_totalprice - before, 2) AS change FROM m WHERE before IS NOT NULL")
def order_changes(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    m = table(spark, sf_dir, "orders").withColumn("before", F.lag("o_totalprice").over(w)).where("before is not null")
    return m.select("o_orderkey", F.round(F.col("o_totalprice") - F.col("before"), 2).alias("change"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
