"""Captured inputs as DataFrames: HAR, proxy XML, sitemaps, robots.txt, archive indexes, URL lists, cookies, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAIR = "ARRAY<STRUCT<name: STRING, value: STRING>>"
HAR = f"""log STRUCT<version: STRING, entries: ARRAY<STRUCT<
  request: STRUCT<method: STRING, url: STRING, headers: {_PAIR}, queryString: {_PAIR}, postData: STRUCT<mimeType: STRING, params: {_PAIR}, text: STRING>>,
  response: STRUCT<status: INT, headers: {_PAIR}, content: STRUCT<size: BIGINT, mimeType: STRING, text: STRING>>>>>"""


def har(spark: SparkSession, path: str) -> DataFrame:
    """url, method, status, mime, params (array<struct<name, value>>), body, is_api."""
    entries = spark.read.schema(HAR).json(path, multiLine=True).select(F.explode("log.entries").alias("e"))
    url = F.col("e.request.url")
    return entries.select(
        url.alias("url"), F.col("e.request.method").alias("method"), F.col("e.response.status").alias("status"), F.col("e.response.content.mimeType").alias("mime"),
        F.coalesce("e.request.postData.params", F.array().cast(_PAIR)).alias("params"), F.col("e.request.postData.text").alias("body"),
        url.rlike(r"(?i)/api/|/rest/|/graphql|/v\d+/|\.json|/ajax/|/service/|/rpc|/ws").alias("is_api"),
    )


def proxy_xml(spark: SparkSession, path: str) -> DataFrame:
    """``<items><item>`` exports: url, method, status, params of url-encoded bodies."""
    items = spark.read.schema("url STRING, method STRING, status INT, request STRING").format("xml").option("rowTag", "item").load(path)
    body = F.regexp_extract("request", r"(?s)\r?\n\r?\n(.*)$", 1)
    pairs = F.filter(F.split(body, "&"), lambda p: p.contains("="))
    params = F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("name"), F.regexp_replace(p, r"^[^=]*=", "").alias("value")))
    return items.select("url", "method", "status", F.when(F.col("method") == "POST", params).otherwise(F.array().cast(_PAIR)).alias("params"))


def sitemap_locations(df: DataFrame, text: str = "value") -> DataFrame:
    """kind (url or sitemap) and loc of sitemap documents, one document a row."""
    xml = F.col(text)
    loc = lambda tag: F.transform(F.regexp_extract_all(xml, F.lit(rf"(?is)<{tag}>\s*<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.struct(F.lit(tag).alias("kind"), x.alias("loc")))
    return df.select(F.explode(F.concat(loc("url"), loc("sitemap"))).alias("x")).select("x.*")


def sitemaps(spark: SparkSession, path: str) -> DataFrame:
    return sitemap_locations(spark.read.text(path, wholetext=True))


def robots(spark: SparkSession, path: str, root: str) -> DataFrame:
    """kind (Allow, Disallow, Sitemap) and url of robots.txt lines; ``/``, ``/*`` and comments are skipped."""
    line = F.trim("value")
    found = spark.read.text(path).select(F.regexp_extract(line, r"^(Allow|Disallow|Sitemap):\s*(\S+)", 1).alias("kind"), F.regexp_extract(line, r"^(Allow|Disallow|Sitemap):\s*(\S+)", 2).alias("x"))
    found = found.where((F.col("kind") != "") & ~F.col("x").isin("/", "/*"))
    return found.select("kind", F.when(F.col("x").rlike("^https?://"), F.col("x")).otherwise(F.concat(F.lit(root.rstrip("/")), F.regexp_replace("x", r"\*.*$", ""))).alias("url"))


def archive_index(spark: SparkSession, path: str, column: int = 2) -> DataFrame:
    """URLs of a saved index response: JSON array of arrays, the first of which names the columns."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "ARRAY<ARRAY<STRING>>")).alias("n", "r"))
    return rows.where("n > 0").select(F.get("r", F.lit(column)).alias("url"))


def crawl_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url STRING").json(path).where("url is not null")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL or JSON object with ``url`` a line; blank lines and comments are skipped."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.when(line.startswith("{"), F.get_json_object(line, "$.url")).otherwise(line).alias("url"))


def cookies(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """name, value, domain from ``json`` arrays, ``netscape`` tables or ``pairs`` of k=v."""
    if kind == "json":
        return spark.read.schema("name STRING, value STRING, domain STRING").json(path, multiLine=True)
    lines = spark.read.text(path).where((F.trim("value") != "") & (~F.col("value").startswith("#") | F.col("value").startswith("#HttpOnly_")))
    if kind == "netscape":
        f = F.split(F.regexp_replace("value", "^#HttpOnly_", ""), "\t")
        return lines.where(F.size(f) >= 7).select(f[5].alias("name"), f[6].alias("value"), f[0].alias("domain"))
    if kind == "pairs":
        pair = lines.select(F.explode(F.split("value", r";\s*")).alias("p")).where(F.col("p").contains("="))
        return pair.select(F.trim(F.split_part("p", F.lit("="), F.lit(1))).alias("name"), F.regexp_replace("p", r"^[^=]*=", "").alias("value"), F.lit(None).cast("string").alias("domain"))
    raise ValueError(f"unknown cookie format {kind}")


def graphql_fields(df: DataFrame, text: str = "value") -> DataFrame:
    """type, kind, field, field_type of introspection responses, without the schema's own ``__`` types."""
    schema = "data STRUCT<__schema: STRUCT<types: ARRAY<STRUCT<name: STRING, kind: STRING, fields: ARRAY<STRUCT<name: STRING, type: STRUCT<name: STRING, kind: STRING>>>>>>>"
    types = df.select(F.explode(F.from_json(text, schema)["data"]["__schema"]["types"]).alias("t")).where(~F.col("t.name").startswith("__"))
    return types.select(F.col("t.name").alias("type"), F.col("t.kind").alias("kind"), F.explode_outer("t.fields").alias("f")).select("type", "kind", F.col("f.name").alias("field"), F.coalesce("f.type.name", "f.type.kind").alias("field_type"))


def site_addresses(maps: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, origin): all addresses of sitemaps and robots files (each with a column url), repeats kept."""
    return maps.select("url", F.lit("sitemap").alias("origin")).unionByName(rules.select("url", F.lit("robots").alias("origin")))


def detected_urls(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of a saved domain report: the JSON object's ``detected_urls`` and ``undetected_urls``, whose entries
    are objects with ``url`` or arrays that begin with it."""
    body = spark.read.text(path, wholetext=True)
    objects = F.from_json("value", "detected_urls ARRAY<STRUCT<url: STRING>>")["detected_urls"]
    lists = F.from_json("value", "undetected_urls ARRAY<ARRAY<STRING>>")["undetected_urls"]
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(F.transform(objects, lambda x: x["url"]), none), F.coalesce(F.transform(lists, lambda x: F.get(x, F.lit(0))), none))
    return body.select(F.explode(both).alias("url")).where("url is not null")


def targets(spark: SparkSession, path: str, per_target: int | None = None) -> DataFrame:
    """(target): the distinct addresses of a batch list, spread by target over ``per_target`` partitions."""
    out = url_list(spark, path).where("url is not null").select(F.when(F.col("url").rlike("^https?://"), F.col("url")).otherwise(F.concat(F.lit("http://"), "url")).alias("target")).distinct()
    return out.repartition(per_target, "target") if per_target else out
