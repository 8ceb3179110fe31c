"""From captured pages to links, assets, forms, scripts' addresses, and other rows: nested regular expressions that
stay in the JVM, then explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls

LINK = r"(?i)<(?:a|area|base)\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"
SOURCE = r"(?i)<(?:script|img|iframe|frame|embed|source)\b[^>]*?\bsrc\s*=\s*[\"']([^\"']*)[\"']"
SHEET = r"(?i)<link\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"
FORM = r"(?i)<form\b([^>]*)>"
TAG = r"<([a-zA-Z][a-zA-Z0-9]*)"
CSS_URL = r"(?i)url\(\s*[\"']?([^\"')]+)[\"']?\s*\)"
JS_PATH = r"[\"'](/[A-Za-z0-9_\-./]+(?:\?[^\"']*)?)[\"']"
JS_API = r"(?i)[\"'](/(?:api|rest|v\d+|graphql)[A-Za-z0-9_\-./]*)[\"']"
SPECIAL = r"(?i)^(mailto|tel|ftp|ws|wss|data):"


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """page_id, pos, link, target: every hyperlink, and each address that it means on its page."""
    found = pages.select("page_id", F.col(url).alias("_u"), F.posexplode(all_of(F.col(html), LINK)).alias("pos", "link"))
    return found.select("page_id", "pos", "link", F.explode(urls.resolve(F.col("_u"), F.col("link"))).alias("target"))


def assets(pages: DataFrame, html: str = "html") -> DataFrame:
    h = F.col(html)
    both = F.concat(
        F.transform(all_of(h, SOURCE), lambda x: F.struct(F.lit("src").alias("kind"), x.alias("asset"))),
        F.transform(all_of(h, SHEET), lambda x: F.struct(F.lit("href").alias("kind"), x.alias("asset"))),
    )
    return pages.select("page_id", F.explode(both).alias("a")).select("page_id", "a.*")


def forms(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, pos, action, method, fields (array<struct<name, type, value, required>>)."""
    whole = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<form\b[^>]*>.*?(?:</form>|$)"), F.lit(0))
    found = pages.select("page_id", F.posexplode(whole).alias("pos", "f"))
    tags = all_of(F.col("f"), r"(?i)(<(?:input|select|textarea)\b[^>]*>)", 1)
    field = F.transform(tags, lambda t: F.struct(
        attribute(t, "name").alias("name"),
        F.when(attribute(t, "type") != "", F.lower(attribute(t, "type"))).when(t.rlike("(?i)^<input"), "text").otherwise(F.lower(F.regexp_extract(t, r"^<(\w+)", 1))).alias("type"),
        attribute(t, "value").alias("value"), t.rlike(r"(?i)\brequired\b").alias("required"),
    ))
    head = F.regexp_extract(F.col("f"), FORM, 1)
    method = F.upper(attribute(head, "method"))
    return found.select("page_id", "pos", attribute(head, "action").alias("action"), F.when(method == "", "GET").otherwise(method).alias("method"), field.alias("fields"))


# What an empty field of a form is filled with, by type.
DEFAULTS = {"email": "test@example.com", "number": "1", "tel": "5550100", "url": "http://example.com", "date": "2024-01-01", "checkbox": "on"}


def form_requests(found: DataFrame) -> DataFrame:
    """The request that each form would make with its default values: method, action, query or body."""
    value = lambda f: F.when(f["value"] != "", f["value"]).otherwise(F.coalesce(*[F.when(f["type"] == k, v) for k, v in DEFAULTS.items()], F.lit("test")))
    named = F.filter("fields", lambda f: (f["name"] != "") & ~f["type"].isin("submit", "button", "reset", "image"))
    body = F.array_join(F.transform(named, lambda f: F.concat(F.url_encode(f["name"]), F.lit("="), F.url_encode(value(f)))), "&")
    return found.select("page_id", "pos", "method", "action", F.when(F.col("method") == "GET", body).otherwise("").alias("query"), F.when(F.col("method") != "GET", body).otherwise("").alias("body"))


def form_pattern() -> Column:
    fields = F.array_sort(F.transform("fields", lambda f: F.concat(f["name"], F.lit(":"), f["type"])))
    return F.concat("method", F.lit(":"), "action", F.lit("["), F.array_join(fields, ","), F.lit("]"))


def text_urls(pages: DataFrame, pattern: str, html: str = "html") -> DataFrame:
    return pages.select("page_id", F.explode(F.array_distinct(all_of(F.col(html), pattern))).alias("found"))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf"(?i)<meta\s+name=[\"']{name}[\"']\s+content=[\"']([^\"']*)[\"']", 1)


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def subdomains(pages: DataFrame, domain: str, html: str = "html", url: str = "url") -> DataFrame:
    """Distinct subdomains of ``domain`` in addresses and texts, with how many labels they add."""
    pattern = r"(?i)\b((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+" + domain.replace(".", r"\.") + r")\b"
    found = pages.select(F.explode(F.concat(all_of(F.col(html), pattern), F.array(urls.hostname(F.col(url))))).alias("h"))
    found = found.select(F.lower("h").alias("subdomain")).where(F.col("subdomain").endswith("." + domain)).distinct()
    return found.withColumn("level", F.size(F.split("subdomain", r"\.")) - len(domain.split(".")))


def response_urls(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Addresses in response headers (map<string,string>)."""
    h = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return df.select("*", F.explode(F.filter(F.array(
        h["location"], h["content-location"], F.regexp_extract(h["link"], r"<([^>]+)>", 1), F.regexp_extract(h["refresh"], r"(?i)url=(.+)$", 1),
    ), lambda x: x.isNotNull() & (x != ""))).alias("found"))


def rate_limits(headers: Column) -> Column:
    get = lambda k: F.try_element_at(headers, F.lit(k)).try_cast("long")
    return F.struct(get("X-RateLimit-Limit").alias("limit"), get("X-RateLimit-Remaining").alias("remaining"), get("X-RateLimit-Reset").alias("reset"))
