"""URL filter: listed rules first, then logistic regression on hashed character n-grams of host and path.

The main path is DataFrame functions only. The model is fitted on a small labelled URL table (bounded by
``MAX_LABELLED`` rows): its n-gram counts are built with the same column expressions, and the weights, one per
hash bucket, enter the scoring expression as a constant array.

A null url, or one without ``://``, has an empty host and path: no rule fits it, and the model judges the
empty address by its bias alone. URLs of any length are read whole. Repeated rows are judged alike; of rules that
are equally long, the first listed wins. An empty table gives an empty one."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import masked, without

MAX_LABELLED = 20_000

# The small labelled URL table (url, 1 = block).
LABELLED = [
    ("https://docs.library.edu/guides/reading", 0),
    ("https://www.museum.org/collection/paintings", 0),
    ("https://en.encyclopedia.org/wiki/River", 0),
    ("https://news.daily.com/world/article/1029", 0),
    ("https://blog.garden.net/en/tomatoes.html", 0),
    ("https://university.edu/courses/algebra", 0),
    ("https://forum.cooking.com/fr/soup", 0),
    ("https://m.weather.com/de/forecast", 0),
    ("https://science.journal.org/papers/2021/cells", 0),
    ("https://history.archive.org/en/1890", 0),
    ("http://www.cityhall.gov/services/parks", 0),
    ("https://developer.tools.io/docs/api/reference", 0),
    ("https://help.software.com/manual/install", 0),
    ("https://www.bookshop.net/es/novels/", 0),
    ("https://health.clinic.org/advice/sleep", 0),
    ("https://music.school.edu/lessons/piano", 0),
    ("https://recipes.kitchen.net/en/bread/", 0),
    ("https://maps.travel.org/fr/mountains", 0),
    ("https://www.chess.org/openings/italian", 0),
    ("https://open.textbook.edu/physics/waves", 0),
    ("https://www.riverside-school.net/news/41", 0),
    ("https://blog.martins-family.info/2019/07/hello.html", 0),
    ("http://orchestra.stadt.org/programm/herbst", 0),
    ("https://www.biblioteca.info/catalogo/historia/", 0),
    ("http://cheap-pills-online.biz/buy/viagra", 1),
    ("http://casino-bonus-777.win/free-spins", 1),
    ("http://hot-xxx-cams.top/live/girls", 1),
    ("http://free-movies-torrent.xyz/download/crack", 1),
    ("http://win-prize-now.click/claim?id=1", 1),
    ("http://adult-video-tube.xxx/porn/hd", 1),
    ("http://poker-bet-slots.club/jackpot", 1),
    ("http://replica-watches-sale.shop/cheap", 1),
    ("http://login-verify-account.tk/secure/update", 1),
    ("http://crypto-doubler-profit.top/invest", 1),
    ("http://payday-loans-fast.biz/apply-now", 1),
    ("http://keygen-serial-crack.xyz/warez", 1),
    ("http://escort-girls-city.club/sex", 1),
    ("http://seo-backlinks-cheap.click/spam", 1),
    ("http://online-casino-slots.win/bet", 1),
    ("http://track.adserver-popunder.xyz/ads/click", 1),
    ("http://viagra-cialis-pharmacy.top/order", 1),
    ("http://free-gift-card-generator.tk/hack", 1),
    ("http://porn-xxx-free.club/videos/sex", 1),
    ("http://miracle-diet-pills.shop/buy-now", 1),
    ("http://betting-jackpot-bonus.biz/casino", 1),
    ("http://torrent-crack-download.win/keygen", 1),
    ("http://hot-singles-dating.click/sex/chat", 1),
    ("http://fake-rolex-outlet.xyz/replica", 1),
    ("https://www.grand-casino.com/en/slots", 1),
    ("https://sports-bets.net/odds/today", 1),
    ("http://adult-videos.com/fr/new", 1),
    ("https://cdn.ads-server.net/banner/88", 1),
    ("http://click-track.com/pixel?id=3", 1),
    ("https://win-money.org/lottery/", 1),
    ("https://xxx-adult.net/de/gallery", 1),
    ("http://free-bet-bonus.com/es/12", 1),
    ("https://www.winterthur.com/en/history", 0),
    ("https://betterhomes.net/garden/3", 0),
    ("https://adultlearning.org/courses/25", 0),
    ("http://thunder.weather.net/en/4410", 0),
    ("https://m.station.com/fr/horaires/", 0),
    ("https://blog.theorem.net/2/proofs.html", 0),
    ("http://nations.info/es/771?page=3", 0),
    ("https://www.tradition.net/de/feste", 0),
]

# The rules (verdict, host, path) of the standard query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlModel:
    weights: list[float]
    bias: float
    lengths: tuple[int, ...]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def gram_buckets(host: Column, path: Column, dims: int, lengths: tuple[int, ...]) -> Column:
    """The hash bucket of every character n-gram of ``^host$`` and ``^path$``, those of the two apart."""
    def grams(marked: Column, field: str, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(field), marked.substr(i, F.lit(n))), F.lit(dims)).cast("int"))

    def of(text: Column, field: str) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        return F.concat(*[grams(marked, field, n) for n in lengths])

    return F.concat(of(host, "h"), of(path, "p"))


def fit(spark: SparkSession, labelled: DataFrame | None = None, dims: int = 2048, lengths: tuple[int, ...] = (3, 4), rounds: int = 4000, rate: float = 60.0, decay: float = 1e-6) -> UrlModel:
    """Logistic regression on each URL's mean of one-hot n-gram buckets, by gradient descent on the driver.
    ``labelled`` has (url, label 0/1); at most MAX_LABELLED rows are taken (by a hash of the url); null urls
    or labels are left out. Without a labelled row, every weight is 0."""
    if labelled is None:
        labelled = spark.createDataFrame(LABELLED, "url string, label int")
    rows = (
        labelled.where("url is not null and label in (0, 1)").select("url", "label")
        .orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED)
        .select("label", gram_buckets(host_of(F.col("url")), path_of(F.col("url")), dims, lengths).alias("b"))
        .collect()
    )
    weights, bias = np.zeros(dims), 0.0
    y = np.array([label for label, _ in rows], float)
    counts = np.array([len(b) for _, b in rows])
    row, gram = np.repeat(np.arange(len(rows)), counts), np.array([i for _, b in rows for i in b], np.int64)
    for _ in range(rounds if rows else 0):
        z = bias + np.bincount(row, weights[gram], len(rows)) / counts
        wrong = (y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) / len(rows)
        bias += float(wrong.sum())
        weights += rate * (np.bincount(gram, (wrong / counts)[row], dims) - decay * weights)
    return UrlModel(weights.tolist(), bias, tuple(lengths))


def blocked_probability(host: Column, path: Column, model: UrlModel) -> Column:
    weights = F.from_json(F.lit(json.dumps(model.weights)), "array<double>")
    grams = gram_buckets(host, path, len(model.weights), model.lengths)
    total = F.aggregate(grams, F.lit(0.0), lambda acc, i: acc + F.get(weights, i))
    return 1.0 / (1.0 + F.exp(-(total / F.size(grams).cast("double") + F.lit(model.bias))))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host and path together; then the first listed) that fits: struct(rule, verdict) or null."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge(df: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] = RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``df`` with host, path, rule, blocked (the model's probability) and verdict. Columns of these names, in any
    case, are replaced; all others may have any name."""
    added = ["host", "path", "rule", "blocked", "verdict"]
    inner, name = masked(df)
    out = inner.withColumns({"host": host_of(F.col(name[url])), "path": path_of(F.col(name[url]))})
    out = out.withColumn("_hit", rule_of(F.col("host"), F.col("path"), rules))
    out = out.withColumn("blocked", blocked_probability(F.col("host"), F.col("path"), model))
    out = out.withColumns({
        "rule": F.col("_hit.rule"),
        "verdict": F.coalesce(F.col("_hit.verdict"), F.when(F.col("blocked") >= threshold, "block").otherwise("allow")),
    })
    return out.select(*[F.col(name[c]).alias(c) for c in without(df.columns, added)], *added)
