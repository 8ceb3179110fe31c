"""Statistics, top lists, set operations, pairing and folds over request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_counts(df: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Counts, sums and whole-number means by each of ``dims`` and overall, in one pass."""
    return df.groupingSets([[d] for d in dims] + [[]], *dims).agg(
        F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.floor(F.avg(value)).cast("long").alias("mean_whole"),
    )


def top(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), *keys).limit(k)


def top_per(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def except_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def in_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_semi")


def adaptive_target(df: DataFrame, key: str, order: list[str], status: Column, response_ms: Column, finds: list[Column]) -> DataFrame:
    """``df`` with target: by how much a key's worth should change after each of its rows, from all rows so far: the
    share that succeeded (below 0.5: -10, above 0.9: +5), what was found by row (above 0.5: +10, below 0.1: -5) and
    the mean time (above 5 s: -3)."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    each = finds[0].cast("int")
    for x in finds[1:]:
        each = each + x.cast("int")
    good = F.avg(status.between(200, 299).cast("int")).over(so_far)
    found = F.sum(each).over(so_far) / F.count("*").over(so_far)
    target = (
        F.when(good < 0.5, -10).when(good > 0.9, 5).otherwise(0) + F.when(found > 0.5, 10).when(found < 0.1, -5).otherwise(0)
        + F.when(F.avg(response_ms).over(so_far) > 5000, -3).otherwise(0)
    )
    return df.withColumn("target", target.cast("double"))


def moving_adjustment(df: DataFrame, key: str, order: list[str], target: Column, rate: float = 0.1, bound: float = 20.0) -> DataFrame:
    """(key, n, adjustment): adj += (target - adj) * rate in order, kept within the bound; a fold over each key's
    own rows, gathered in order."""
    rows = df.select(key, F.struct(*order, target.cast("double").alias("t")).alias("r")).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    step = lambda a, r: F.greatest(F.lit(-bound), F.least(F.lit(bound), a + (r["t"] - a) * rate))
    return rows.select(key, F.size("rows").alias("n"), F.round(F.aggregate("rows", F.lit(0.0), step), 6).alias("adjustment"))


def pair_last_open(events: DataFrame, key: str, order: list[str], id_col: str, is_open: Column, is_close: Column) -> DataFrame:
    """(opened, closed): each closing row pairs with the most recent opening row of its key that is still open.

    As with brackets: rows get a nesting level from running sums, and a closing row's partner is the last opening
    row of the same level before it. Closing rows with nothing open pair with nothing."""
    w = Window.partitionBy(key).orderBy(*order)
    kind = F.when(is_open, 1).when(is_close, -1).otherwise(0)
    rows = events.select(key, *order, F.col(id_col).alias("_id"), kind.alias("d")).where("d <> 0")
    total = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("total", total)
    low = F.least(F.lit(0), F.min("total").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("low", low).withColumn("depth", F.col("total") - F.col("low"))
    before = F.lag("low", 1, 0).over(w)
    rows = rows.withColumn("lost", (F.col("d") == -1) & (F.col("low") < before)).where("not lost")
    rows = rows.withColumn("level", F.when(F.col("d") == 1, F.col("depth")).otherwise(F.col("depth") + 1))
    at_level = Window.partitionBy(key, "level").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("opened", F.last(F.when(F.col("d") == 1, F.col("_id")), ignorenulls=True).over(at_level))
    return rows.where("d = -1").select(F.col("opened"), F.col("_id").alias("closed"))


def recent_mean(df: DataFrame, key: str, order: list[str], value: str, rows: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-rows, -1)
    return df.withColumn("recent_mean", F.round(F.avg(value).over(w), 6))


def chains(redirects: DataFrame, most: int = 10) -> DataFrame:
    """(original, final, hops): follow (original -> final) until no redirect is left, at most ``most`` hops, one join a
    hop."""
    step = redirects.groupBy("original").agg(F.min("final").alias("final")).where("original <> final")
    paths = step.select("original", "final", F.lit(1).alias("hops"))
    for _ in range(most - 1):
        nxt = paths.join(step.select(F.col("original").alias("final"), F.col("final").alias("_next")), "final", "left")
        paths = nxt.select("original", F.coalesce("_next", "final").alias("final"), F.when(F.col("_next").isNull(), F.col("hops")).otherwise(F.col("hops") + 1).alias("hops"))
    return paths


def layers(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): breadth-first from ``seeds`` (node) over ``links`` (src, dst), each node at its first depth."""
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        nxt = links.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = nxt.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def union_of(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, sources): every distinct key of the named tables, and how many of them have it."""
    every = None
    for name, df in sources.items():
        own = df.select(F.col(key), F.lit(name).alias("_s"))
        every = own if every is None else every.unionByName(own)
    return every.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("_s").alias("sources"))


def shares(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(name, total, n, share) of each flag over all rows, in one pass; the share of no rows is 0."""
    one = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"n{i}") for i, c in enumerate(flags.values())])
    each = F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"n{i}").alias("n")) for i, k in enumerate(flags)])
    out = one.select("total", F.explode(each).alias("x"))
    return out.select("x.name", "total", "x.n", F.round(F.when(F.col("total") > 0, F.col("x.n") / F.col("total")).otherwise(0.0), 6).alias("share"))


# Weights of the parts of an address's priority before anything was learnt.
WEIGHTS = {"depth": 3.0, "internal": 2.0, "params": 1.5, "path_value": 4.0}


def page_worth(links: Column, apis: Column, forms: Column, status: Column) -> Column:
    """What a fetched page was worth, 0 to 100, by what was found on it and its status."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (
        50.0 + F.when(apis > 0, 20.0).otherwise(0.0) + F.when(forms > 0, 15.0).otherwise(0.0)
        + F.when(links > 10, 10.0).when(links > 5, 5.0).otherwise(0.0) + F.when(status == 200, 5.0).when(status >= 400, -20.0).otherwise(0.0)
    )))


def learned_weights(results: DataFrame, layer: str = "layer", rate: float = 0.15, start: dict[str, float] = WEIGHTS) -> DataFrame:
    """(layer, pages, high_rate, low_rate, api_rate, success_rate, changed, depth, internal, params, path_value): the weights
    after every layer. ``results``: layer, links, apis, forms, status. All rates are over the pages so far. Weights are
    changed after layers that end at a multiple of 50 pages, where few pages were of high worth, many of low worth, or
    APIs are found often. One row a layer is left before the window, so it may be unpartitioned."""
    worth = page_worth(F.col("links"), F.col("apis"), F.col("forms"), F.col("status"))
    per = results.groupBy(layer).agg(
        F.count("*").alias("n"), F.count_if(worth >= 80).alias("high"), F.count_if(worth < 50).alias("low"),
        F.sum("apis").alias("found"), F.count_if(F.col("status").between(200, 299)).alias("good"),
    )
    w = Window.orderBy(layer).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(w)
    so_far = per.select(layer, total.alias("pages"), *[(F.sum(c).over(w) / total).alias(a) for c, a in (("high", "high_rate"), ("low", "low_rate"), ("found", "api_rate"), ("good", "success_rate"))])
    few, many, apis = F.col("high_rate") < 0.2, F.col("low_rate") > 0.5, F.col("api_rate") > 0.3
    changed = so_far.withColumn("changed", (F.col("pages") >= 20) & (F.col("pages") % 50 == 0) & (few | many | apis))
    factors = {"depth": (many, 1 - rate * 0.5), "internal": (F.col("success_rate") < 0.7, 1 + rate * 0.8), "params": (apis, 1 + rate), "path_value": (few, 1 + rate)}
    grown = [(F.lit(start[k]) * F.product(F.when(F.col("changed") & c, f).otherwise(1.0)).over(w)).alias(k) for k, (c, f) in factors.items()]
    return changed.select(*changed.columns, *grown)


def captured_requests(log: DataFrame, domain: str = "", refused: list[str] = (), url: str = "url") -> DataFrame:
    """The requests of a proxy's log whose host contains ``domain`` and whose address contains none of ``refused``;
    without a domain, all."""
    if not domain:
        return log
    u = F.col(url)
    host = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    keep = F.contains(host, F.lit(domain))
    for x in refused:
        keep = keep & ~F.contains(u, F.lit(x))
    return log.where(keep)


def capture_counts(log: DataFrame, host: Column, method: Column) -> DataFrame:
    """(host, method, n): requests by host, by method and in all, nulls where not counted by."""
    named = log.select(host.alias("host"), method.alias("method"))
    return named.groupingSets([["host"], ["method"], []], "host", "method").agg(F.count("*").alias("n"))


def with_state(addresses: DataFrame, visited: DataFrame, failed: DataFrame, key: str = "url") -> DataFrame:
    """(key, state): every distinct address as visited, failed or pending; what was visited has not failed."""
    done = visited.select(key).distinct().withColumn("_v", F.lit(True))
    bad = failed.select(key).distinct().withColumn("_f", F.lit(True))
    every = addresses.select(key).unionByName(visited.select(key)).unionByName(failed.select(key)).where(F.col(key).isNotNull()).distinct()
    state = F.when(F.col("_v"), "visited").when(F.col("_f"), "failed").otherwise("pending")
    return every.join(done, key, "left").join(bad, key, "left").select(key, state.alias("state"))


def progress(states: DataFrame) -> DataFrame:
    """One row: visited, failed, pending and the percentage visited of all; 0 without addresses."""
    counted = states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("visited", "failed", "pending")])
    total = F.col("visited") + F.col("failed") + F.col("pending")
    return counted.withColumn("percent", F.round(F.when(total > 0, F.col("visited") / total * 100).otherwise(0.0), 2))


def findings(tagged: Column) -> Column:
    """struct(kind, url) of a finding written as ``KIND: url``; without a kind, it is empty."""
    kind = F.regexp_extract(tagged, r"^([A-Z_]+): ", 1)
    return F.struct(kind.alias("kind"), F.when(kind == "", tagged).otherwise(F.regexp_replace(tagged, r"^[A-Z_]+: ", "")).alias("url"))
