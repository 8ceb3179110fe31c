"""Composed plans: scope options, the managed and the legacy decision pipelines, and a decision with its counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scores, urls
from tidemark.operators import dedup, filters
from tidemark.plans.registry import DOMAIN, LIMITER, Q, _scalar, query, requests

MODES = ("domain", "host", "registered", "custom")


@dataclass(frozen=True)
class ScopeOptions:
    """What may be crawled. Values out of range are set right instead of refused."""

    domain: str
    mode: str = "domain"
    max_depth: int = 10
    prefixes: tuple[str, ...] = ()
    excluded_parts: tuple[str, ...] = ()
    excluded_extensions: tuple[str, ...] = ()
    pattern: str = ""
    max_parameters: int = 50
    allow_query: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "max_depth", min(100, max(1, self.max_depth)))
        object.__setattr__(self, "max_parameters", min(1000, max(0, self.max_parameters)))
        if self.mode not in MODES:
            object.__setattr__(self, "mode", "domain")


def scope_reason(url: Column, o: ScopeOptions) -> Column:
    """Why an address is outside the scope, or null."""
    h, p = urls.hostname(url), urls.path(url)
    inside = {
        "domain": urls.in_domain(h, o.domain), "host": h == o.domain,
        "registered": urls.base_domain(url) == ".".join(o.domain.split(".")[-2:]), "custom": h.rlike(o.pattern or ".*"),
    }[o.mode]
    out = F.when(~urls.scheme(url).isin("http", "https"), "scheme").when(~inside, "host").when(F.size(urls.segments(url)) > o.max_depth, "depth")
    if o.excluded_extensions:
        out = out.when(urls.extension(url).isin(list(o.excluded_extensions)), "extension")
    if o.prefixes:
        prefix = F.lit(False)
        for x in o.prefixes:
            prefix = prefix | p.startswith(x)
        out = out.when(~prefix, "path")
    for x in o.excluded_parts:
        out = out.when(p.contains(x), "excluded path")
    if not o.allow_query:
        out = out.when(urls.query(url) != "", "query")
    return out.when(F.size(urls.sorted_keys(url)) > o.max_parameters, "parameters")


# What the prepared scopes take and leave.
SCOPES = {
    "api": {"prefixes": ("/api/", "/v1/", "/v2/"), "excluded_extensions": ("jpg", "png", "gif", "css", "js")},
    "admin": {"prefixes": ("/admin/", "/manage/", "/backend/"), "excluded_parts": ("/logout", "/signout")},
    "static": {
        "excluded_extensions": (
            "jpg", "jpeg", "png", "gif", "svg", "ico", "webp", "css", "less", "sass", "scss", "woff", "woff2", "ttf", "eot", "otf",
            "mp4", "mp3", "avi", "mov", "pdf", "doc", "docx", "xls", "xlsx", "zip", "rar", "tar", "gz",
        ),
    },
}


def prepared_scope(name: str, domain: str) -> ScopeOptions:
    """The options of a prepared scope (``api``, ``admin``, ``static``) for a domain."""
    return ScopeOptions(domain=domain, **SCOPES[name])


def value_pattern(url: Column) -> Column:
    """Sorted names, each with ``{num}`` for numbers, ``{multi}`` where it stands more than once, else ``{value}``."""
    own = urls.pairs(url)
    name = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    marks = F.transform(urls.sorted_keys(url), lambda k: F.concat(
        k, F.lit("="),
        F.when(F.size(F.filter(own, lambda p: name(p) == k)) > 1, "{multi}")
        .when(F.exists(own, lambda p: (name(p) == k) & p.rlike(r"=\d+$")), "{num}").otherwise("{value}"),
    ))
    return urls.with_query(urls.base(url), marks, "", "&")


def managed(df: DataFrame, url: str, order: list[str], options: filters.Options, depth: Column, per_layer: int = 500) -> DataFrame:
    """Filter chain, then exact de-duplication, then the best of each layer by priority; every row at most once."""
    c = F.col(url)
    judged = df.withColumn("verdict", filters.judge(c, options)).where("verdict.allowed").drop("verdict")
    unique = dedup.first_seen(judged, urls.exact_key(c), order)
    ranked = unique.withColumns({"depth": depth, "priority": F.round(scores.priority(c, depth, options.domain), 6)})
    w = Window.partitionBy("depth").orderBy(F.col("priority").desc(), *order)
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_layer)


def legacy(df: DataFrame, url: str, order: list[str]) -> DataFrame:
    """Layered de-duplication, the cap by type, then the business cap."""
    c = F.col(url)
    layered = dedup.first_seen(df, dedup.layer_key(c), order)
    capped = dedup.capped(layered, [urls.limiter_pattern(c)], order, dedup.type_limit(scores.limiter_type(c)))
    return dedup.business_cap(capped, url, order).where("allowed").drop("allowed")


def decisions(df: DataFrame, url: str, order: list[str]) -> DataFrame:
    """``df`` with decision: exact duplicate, pattern duplicate, or new."""
    c = F.col(url)
    named = df.withColumns({"_e": urls.exact_key(c), "_p": urls.param_pattern(c)})
    for k in ("_e", "_p"):
        named = named.withColumn(f"{k}n", F.row_number().over(Window.partitionBy(k).orderBy(*order)))
    return named.withColumn("decision", F.when(F.col("_en") > 1, "exact").when(F.col("_pn") > 1, "pattern").otherwise("new")).drop("_e", "_p", "_en", "_pn")


_scalar("value_pattern", value_pattern, "CASE WHEN len(names)>0 THEN base||'?'||array_to_string(list_transform(names, lambda n: n||'='||CASE WHEN len(list_filter(pairs, lambda p: split_part(p,'=',1)=n))>1 THEN '{multi}' WHEN len(list_filter(pairs, lambda p: split_part(p,'=',1)=n AND regexp_matches(p,'=\\d+$')))>0 THEN '{num}' ELSE '{value}' END),'&') ELSE base END")
_scalar("scope_reason", lambda u: scope_reason(u, ScopeOptions(DOMAIN, max_depth=3, excluded_extensions=("png",), excluded_parts=("/user/",))),
        f"CASE WHEN scheme NOT IN ('http','https') THEN 'scheme' WHEN NOT (hostname='{DOMAIN}' OR hostname LIKE '%.{DOMAIN}') THEN 'host' WHEN len(seg)>3 THEN 'depth' WHEN ext='png' THEN 'extension' WHEN contains(path,'/user/') THEN 'excluded path' WHEN len(names)>50 THEN 'parameters' END")

_PAT = "CASE WHEN len(names)>0 THEN base||'?'||array_to_string(names,'=&')||'=' ELSE base END"
_EXACT = "CASE WHEN len(pairs)>0 THEN base||'?'||array_to_string(list_sort(pairs),'&') ELSE base END"


@query(f"{Q}, d AS (SELECT row_number() OVER (PARTITION BY {_EXACT} ORDER BY ts, event_id) AS e, row_number() OVER (PARTITION BY {_PAT} ORDER BY ts, event_id) AS p FROM k) SELECT CASE WHEN e>1 THEN 'exact' WHEN p>1 THEN 'pattern' ELSE 'new' END AS decision, count(*) AS n FROM d GROUP BY 1")
def dedup_decisions(spark, sf_dir):
    return decisions(requests(spark, sf_dir), "url", ["ts", "event_id"]).groupBy("decision").agg(F.count("*").alias("n"))


@query(None)
def pipeline_managed(spark, sf_dir):
    r = requests(spark, sf_dir).select("ts", "event_id", "user_id", "url")
    out = managed(r, "url", ["ts", "event_id"], filters.preset("balanced", DOMAIN), F.lit(1) + F.col("user_id") % 4)
    return out.select("event_id", "depth", "priority", "place", "url")


@query(None)
def pipeline_legacy(spark, sf_dir):
    return legacy(requests(spark, sf_dir).select("ts", "event_id", "url"), "url", ["ts", "event_id"]).select("event_id", "business_score", "url")


@query(f"{Q}, m AS (SELECT {LIMITER} AS pattern, max(CASE WHEN query<>'' THEN 1 ELSE 0 END) AS q, count(*) AS before, count(DISTINCT url) AS after FROM k GROUP BY 1) SELECT pattern, before, after, round(1 - after/before, 6) AS saved FROM m")
def dedup_savings(spark, sf_dir):
    u = F.col("url")
    g = requests(spark, sf_dir).groupBy(urls.limiter_pattern(u).alias("pattern")).agg(F.count("*").alias("before"), F.count_distinct("url").alias("after"))
    return g.withColumn("saved", F.round(1 - F.col("after") / F.col("before"), 6))
