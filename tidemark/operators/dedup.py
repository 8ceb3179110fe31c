"""De-duplication, grouping and caps over an explicit order. Caps are ranks within a key, so they need no state
beyond a window; groups are aggregated before they are shuffled wherever that is possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scores, urls


def first_seen(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """One row per key: the first in order. Aggregation only: one candidate per key and task is shuffled."""
    cols = [c for c in df.columns if c not in order]
    least = df.withColumn("_key", key).groupBy("_key").agg(F.min(F.struct(*order, *cols)).alias("_r"))
    return least.select("_r.*").select(*df.columns)


def mark_duplicates(df: DataFrame, key: Column, order: list[str], id_col: str) -> DataFrame:
    """``df`` with original (the first row's id of its key) and is_duplicate."""
    first = df.select(key.alias("_key"), F.struct(*order, id_col).alias("_o")).groupBy("_key").agg(F.min("_o")[id_col].alias("original"))
    return df.withColumn("_key", key).join(first, "_key").withColumn("is_duplicate", F.col("original") != F.col(id_col)).drop("_key")


def groups(df: DataFrame, key: Column, value: str, samples: int = 5) -> DataFrame:
    """key, n, distinct values, and up to ``samples`` of the smallest ones."""
    per = df.select(key.alias("key"), F.col(value).alias("v")).groupBy("key", "v").agg(F.count("*").alias("c"))
    rank = per.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("v")))
    return rank.groupBy("key").agg(
        F.sum("c").alias("n"), F.count("*").alias("variants"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= samples, F.col("v")))).alias("samples"),
    )


def capped(df: DataFrame, keys: list[Column], order: list[str], limit: Column, most: int | None = None) -> DataFrame:
    """The first ``limit`` rows of each key: rows beyond it don't use it up, so a rank is all it takes. ``most``: no
    limit is above it; being a literal, it lets every task drop what can't be among a key's first before the shuffle."""
    named = df.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(*order)
    ranked = named.withColumn("_r", F.row_number().over(w))
    return (ranked if most is None else ranked.where(F.col("_r") <= most)).where(F.col("_r") <= limit).drop("_r", *[f"_k{i}" for i in range(len(keys))])


#: Rows kept per pattern, by the pattern's type.
TYPE_LIMITS = {"api": 5, "form": 5, "image": 2, "static": 1, "normal": 3}


def type_limit(kind: Column, limits: dict[str, int] = TYPE_LIMITS) -> Column:
    out = F.when(F.lit(False), 0)
    for k, n in limits.items():
        out = out.when(kind == k, n)
    return out.otherwise(limits["normal"])


def layer_key(url: Column) -> Column:
    """What makes two URLs the same, by their type: REST, AJAX and static ones by all of it, file parameters by
    pattern and encoding, others by their parameter pattern."""
    kind = scores.url_type(url)
    value = F.regexp_extract(urls.query(url), r"(?i)(?:file|path|doc|download|upload)[^=&]*=([^&]*)", 1)
    return (
        F.when(kind.isin("RESTful", "AJAX", "StaticAsset"), F.concat(F.lit("url:"), url))
        .when(kind == "FileParam", F.concat(F.lit("file:"), urls.param_pattern(url), F.lit(":"), scores.encoding_type(value)))
        .otherwise(F.concat(F.lit("pattern:"), urls.param_pattern(url)))
    )


def business_cap(df: DataFrame, url: str, order: list[str]) -> DataFrame:
    """``df`` with business_score, nth (of its pattern) and allowed."""
    c = F.col(url)
    w = Window.partitionBy("_p").orderBy(*order)
    out = df.withColumns({"_p": scores.business_pattern(c), "business_score": scores.business_score(c)}).withColumn("nth", F.row_number().over(w))
    s, n = F.col("business_score"), F.col("nth")
    allowed = (n == 1) | (s >= 70) | ((s >= 30) & (n <= F.when(s >= 50, 5).otherwise(2)))
    return out.withColumn("allowed", allowed).drop("_p")


def parameter_profile(df: DataFrame, url: str) -> DataFrame:
    """pattern, parameter, n, distinct_values."""
    c = F.col(url)
    exploded = df.select(urls.param_pattern(c).alias("pattern"), F.explode(urls.params(c)).alias("p"))
    return exploded.groupBy("pattern", F.col("p.k").alias("parameter")).agg(F.count("*").alias("n"), F.count_distinct("p.v").alias("distinct_values"))
