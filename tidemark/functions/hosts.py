"""Hosts, API paths, login and delivery-network tests, and form fields' meanings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls

# Domains of delivery networks (an excerpt; ``cdn_hosts`` takes any table of domains).
CDN_DOMAINS = ["cloudflare.com", "cloudflare.net", "akamai.net", "akamaihd.net", "fastly.net", "jsdelivr.net", "unpkg.com", "googleapis.com", "gstatic.com", "bootstrapcdn.com", "cloudfront.net", "amazonaws.com", "azureedge.net", "aliyuncs.com", "alicdn.com", "myqcloud.com", "bdstatic.com", "qiniucdn.com", "upaiyun.com"]
# Names that form fields of one meaning go by.
FIELD_WORDS = {
    "email": ["email", "mail"], "phone": ["phone", "mobile", "tel"], "user": ["username", "user", "login", "account"],
    "password": ["password", "passwd", "pwd"], "name": ["name", "firstname", "lastname"], "search": ["search", "query", "keyword"],
    "date": ["date", "birthday"], "address": ["address", "street", "city"], "comment": ["comment", "message", "content"], "id": ["id", "code"],
}
# Path keywords by tier.
PATH_PRIORITY = [(9, ["admin", "login", "config", "backup", "upload"]), (6, ["api", "user", "account", "manage", "dashboard"]), (3, ["search", "list", "view", "page", "product"])]


def is_cdn(host: Column, domains: list[str] = CDN_DOMAINS) -> Column:
    return host.rlike("(^|\\.)(" + "|".join(d.replace(".", "\\.") for d in domains) + ")$") | host.rlike(r"(^|\.)(cdn\d*|static\d*|assets|img\d*)\.")


def ip_class(host: Column) -> Column:
    return F.when(urls.is_private_ipv4(host), "private").when(urls.is_ipv4(host), "public").otherwise("name")


def api_version(url: Column) -> Column:
    return F.regexp_extract(F.lower(urls.path(url)), r"/v(\d+)(?:/|$)", 1)


def api_kind(url: Column) -> Column:
    p = F.lower(urls.path(url))
    return F.when(p.contains("graphql"), "graphql").when(p.rlike(r"/(soap|wsdl)"), "soap").when(p.rlike(r"/(api|rest)/|/v\d+/"), "rest").otherwise("none")


def operation_id(method: str, url: Column) -> Column:
    words = F.transform(F.filter(urls.segments(url), lambda s: ~s.rlike(r"^\d+$")), lambda s: F.initcap(F.regexp_replace(s, r"[^A-Za-z0-9]+", "")))
    return F.concat(F.lit(method.lower()), F.array_join(words, ""))


def auth_redirect(target: Column) -> Column:
    """Whether a redirect leads to a login."""
    return F.lower(urls.path(target)).rlike(r"/(login|signin|sign-in|auth|oauth|sso|cas|saml|account/login|user/login|passport)(/|\.|$)") | urls.hostname(target).rlike(r"^(login|auth|sso|passport|accounts?|id|signin)\.")


def path_priority(url: Column) -> Column:
    p = F.lower(urls.path(url))
    out = F.when(F.lit(False), 0)
    for n, words in PATH_PRIORITY:
        out = out.when(p.rlike("|".join(words)), n)
    return out.otherwise(1)


def field_meaning(name: Column) -> Column:
    """The meaning of a form field: a vocabulary word that it contains, else one at least 0.8 alike by edit distance."""
    n = F.lower(name)
    out = F.when(n.isNull() | (n == ""), None)
    for meaning, words in FIELD_WORDS.items():
        out = out.when(n.rlike("|".join(words)), meaning)
    for meaning, words in FIELD_WORDS.items():
        near = F.exists(F.array(*map(F.lit, words)), lambda w: 1 - F.levenshtein(n, w) / F.greatest(F.length(n), F.length(w)) >= 0.8)
        out = out.when(near, meaning)
    return out.otherwise("other")


def vocabulary(df: DataFrame, url: str) -> DataFrame:
    """Distinct path segments, digits as ``{id}``, with how often they stand."""
    seg = df.select(F.explode(F.transform(urls.segments(F.col(url)), lambda s: F.regexp_replace(s, r"\d+", "{id}"))).alias("segment"))
    return seg.groupBy("segment").agg(F.count("*").alias("n"))


def parameter_variants(url: Column, extra: list[str] = ("id", "page", "debug")) -> Column:
    """array<string>: the address with each common parameter added, and with each of its own left out."""
    own = urls.pairs(url)
    more = F.transform(F.array(*map(F.lit, extra)), lambda e: F.concat(urls.base(url), F.lit("?"), F.array_join(F.concat(own, F.array(F.concat(e, F.lit("=")))), "&")))
    less = F.transform(own, lambda p: urls.with_query(urls.base(url), F.filter(own, lambda q: q != p), "", "&"))
    return F.array_distinct(F.concat(more, less))


def cookie_header(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda c: F.concat(c["name"], F.lit("="), c["value"])), "; ")
