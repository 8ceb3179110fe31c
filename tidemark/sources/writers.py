"""Results as files: URL lists, NDJSON, CSV reports, OpenAPI and GraphQL documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def url_text(df: DataFrame, url: str, path: str) -> None:
    df.select(F.col(url).cast("string")).where(F.col(url).isNotNull()).distinct().orderBy(url).write.mode("overwrite").text(path)


def ndjson(df: DataFrame, path: str, unique: str | None = "url") -> None:
    (df.dropDuplicates([unique]) if unique else df).write.mode("overwrite").json(path)


def leak_csv(found: DataFrame, path: str) -> None:
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    found.orderBy(rank, "type", "id", "line_no").write.mode("overwrite").option("header", True).csv(path)


def openapi_paths(endpoints: DataFrame) -> DataFrame:
    """(path, document): the JSON of each path's methods, from rows (path, method, parameters array<string>)."""
    merged = endpoints.groupBy("path", F.lower("method").alias("m")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("parameters")))).alias("ps"))
    operation = F.struct(
        F.concat(F.col("m"), F.regexp_replace("path", r"[^A-Za-z0-9]+", "_")).alias("operationId"),
        F.transform("ps", lambda p: F.struct(p.alias("name"), F.lit("query").alias("in"), F.struct(F.lit("string").alias("type")).alias("schema"))).alias("parameters"),
    )
    return merged.groupBy("path").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("m"), operation))))).alias("document"))


def schema_language(fields: DataFrame) -> DataFrame:
    """(type, sdl) from rows (type, kind, field, field_type)."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "field_type")))), lambda f: F.concat(F.lit("  "), f["field"], F.lit(": "), f["field_type"])), "\n")
    return fields.where("kind = 'OBJECT'").groupBy("type").agg(lines.alias("_l")).select("type", F.concat(F.lit("type "), "type", F.lit(" {\n"), "_l", F.lit("\n}")).alias("sdl"))


def details(pages: DataFrame, links: DataFrame, path: str) -> None:
    """A JSON line a page (page_id, url) with its sorted distinct links, from rows (page_id, link)."""
    per = links.groupBy("page_id").agg(F.array_sort(F.collect_set("link")).alias("links"))
    pages.select("page_id", "url").join(per, "page_id", "left").withColumn("n_links", F.coalesce(F.size("links"), F.lit(0))).write.mode("overwrite").json(path)


def run_export(parts: dict[str, DataFrame], path: str) -> None:
    """Every named table of a run as JSON lines in a folder of its name."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def patterns(df: DataFrame, column: str, path: str) -> None:
    """The distinct values of a column, sorted, a line each."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").write.mode("overwrite").text(path)


def request_log(requests: DataFrame, path: str, form: str = "json") -> None:
    """Requests (ts, method, url, status) in order, as JSON lines or as lines of text."""
    rows = requests.orderBy("ts", "url")
    if form == "json":
        rows.select("ts", "method", "url", "status").write.mode("overwrite").json(path)
    elif form == "text":
        rows.select(F.format_string("[%s] %s %s %s", F.col("ts").cast("string"), "method", "url", F.coalesce(F.col("status").cast("string"), F.lit("-")))).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown form {form}")


def leak_text(found: DataFrame) -> DataFrame:
    """(line): a line a find, the gravest first."""
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    return found.orderBy(rank, "type", "id", "line_no").select(F.format_string("[%s] %s: %s (%s, line %d)", "severity", "type", "value", F.col("id").cast("string"), "line_no").alias("line"))
