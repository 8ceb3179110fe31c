"""Captured responses: signatures, runs of like answers, request de-duplication, page embeddings, script text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from tidemark.operators import extract

DIMS = 256


def request_key(method: Column, url: Column, params: Column) -> Column:
    """MD5 of a request with its parameters (map<string,string>) sorted."""
    own = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return F.md5(F.concat_ws("|", F.upper(method), url, own))


def response_likeness(a: Column, b: Column) -> Column:
    """0.3 status, 0.3 length (whole where they differ by less than 50 bytes), 0.3 body, 0.1 title, of structs
    (status, length, hash, title); a title that both lack has no weight, and the rest is scaled up."""
    apart = F.abs(a["length"] - b["length"])
    length = F.when(apart < 50, 1.0).otherwise(1 - apart / F.greatest(a["length"], b["length"], F.lit(1)))
    base = 0.3 * (a["status"] == b["status"]).cast("int") + 0.3 * length + 0.3 * (a["hash"] == b["hash"]).cast("int")
    none = (a["title"] == "") & (b["title"] == "")
    return F.when(none, base / 0.9).otherwise(base + 0.1 * (a["title"] == b["title"]).cast("int"))


def until_alike(df: DataFrame, key: str, order: list[str], like: Column, runs: int = 3) -> DataFrame:
    """Rows up to and with the ``runs``-th in a row that is like the one before: gaps and islands."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(like, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_island", island)
    out = out.withColumn("_run", F.row_number().over(Window.partitionBy(key, "_island").orderBy(*order)) - F.when(F.col("_island") == 0, 0).otherwise(1))
    stops = F.sum(F.when(F.col("_run") >= runs, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("_done", F.coalesce(stops, F.lit(0))).where("_done = 0").drop("_island", "_run", "_done")


def page_features(html: Column) -> Column:
    """Counts of telling substrings: array<long>."""
    return F.array(*[F.regexp_count(html, F.lit(p)).cast("long") for p in ("<div", "<a ", "<p", "<form", "<input", "<script", "<table", "<img", "<li")])


# Weights of tags in a page's embedding, and the attributes that name a node.
TAG_WEIGHTS = {"title": 2.0, "h1": 1.8, "h2": 1.6, "h3": 1.4, "form": 1.5, "input": 1.3, "button": 1.3, "a": 1.2, "div": 1.0, "span": 1.0, "p": 1.0}
NODE_ATTRIBUTES = ("id", "class", "name", "type", "href", "src")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """A page's nodes: (depth, tag, attributes, text of all below, up to 50 bytes)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []
        self.nodes: list[list] = []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        node = [len(self.open), tag, [f"{k}={own[k]}" for k in NODE_ATTRIBUTES if own.get(k)], ""]
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if any(n[1] == tag for n in self.open):
            while self.open.pop()[1] != tag:
                pass

    def handle_data(self, data):
        for node in self.open:
            if len(node[3]) < 50:  # what stands at the front after the blanks is enough
                node[3] = (node[3] + data).lstrip()[:60]


def embed(html: str | None) -> np.ndarray:
    """Every node as one string (tag, attributes, text) is hashed by FNV-1a; its place is the hash times 1.5 to the
    depth times the tag's weight, whole, modulo DIMS: in exact arithmetic, not in that of 64 bits, which would put nearly
    every node into place 0. Of length 1, or all 0 without a node."""
    tree, vector = _Tree(), np.zeros(DIMS)
    tree.feed(html or "")
    tree.close()
    for depth, tag, named, text in tree.nodes:
        front = text.strip().encode()[:50]
        h = 0xCBF29CE484222325
        for b in "|".join([tag, *named]).encode() + (b"|text=" + front if front else b""):
            h = (h ^ b) * 0x100000001B3 % 2**64
        vector[h * 3**depth * round(10 * TAG_WEIGHTS.get(tag, 1.0)) // (2**depth * 10) % DIMS] += 1.0
    n = np.sqrt((vector**2).sum())
    return vector / n if n else vector


@F.pandas_udf(ArrayType(DoubleType()))
def page_embedding(html: pd.Series) -> pd.Series:
    return html.map(lambda text: embed(text).tolist())


# A shard's largest size, how many shards small tables are dealt into, and what single precision may be off by.
SHARD, SPREAD, SLACK = 8192, 10, 1e-4


def _best_of(ids: np.ndarray, v: np.ndarray, c_ids: np.ndarray, c: np.ndarray, step: int = 256) -> pd.DataFrame:
    """(id, other, cosine): each row's best of the candidates, its own id apart. Single precision finds those within
    SLACK of the best, double precision decides. Of equal candidates the two smallest ids are enough."""
    order = np.argsort(c_ids, kind="stable")
    equal = pd.Series([c[i].tobytes() for i in order])
    few = order[equal.groupby(equal).cumcount().to_numpy() < 2]
    c_ids, c = c_ids[few], c[few]
    single, out = c.astype(np.float32).T.copy(), []
    for at in range(0, len(ids), step):
        s = v[at : at + step].astype(np.float32) @ single
        s[ids[at : at + step, None] == c_ids] = -np.inf
        top = s.max(axis=1, keepdims=True)
        rows, cols = np.nonzero((s >= top - SLACK) & (top > -np.inf))
        for i in range(0, len(rows), 8192):
            r, k = at + rows[i : i + 8192], cols[i : i + 8192]
            out.append(pd.DataFrame({"id": ids[r], "other": c_ids[k], "cosine": np.einsum("ij,ij->i", v[r], c[k]).round(6)}))
    found = pd.concat(out) if out else pd.DataFrame({"id": ids[:0], "other": c_ids[:0], "cosine": np.empty(0)})
    return found.sort_values(["cosine", "other"], ascending=[False, True]).drop_duplicates("id")


def best_match(pages: DataFrame, shard: int = SHARD) -> DataFrame:
    """(id, other, cosine): for each page (id, v of length 1; ids are unique) the most alike of all others, ties in
    the rounded cosine going to the smaller id; null where there is no other. Pages are dealt into shards of bounded
    size and every two shards meet in a tile, so every pair is compared and no task holds all pages."""
    n = pages.count()
    shards = max(1, -(-n // shard), min(SPREAD, n // 64))
    own = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    tiled = pages.select("id", "v", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("met"))

    def tile(part: pd.DataFrame) -> pd.DataFrame:
        whole = {k: (g["id"].to_numpy(), np.stack(list(g["v"]))) for k, g in part.groupby("own")}
        both = [(x, y) for x in whole for y in whole if x != y or part["met"].iloc[0] == part["own"].iloc[0]]
        return pd.concat([_best_of(*whole[x], *whole[y]) for x, y in both] or [pd.DataFrame({"id": [], "other": [], "cosine": []})])

    lists = tiled.groupBy(F.least("own", "met").alias("x"), F.greatest("own", "met").alias("y")).applyInPandas(tile, "id long, other long, cosine double")
    best = lists.groupBy("id").agg(F.max(F.struct("cosine", (-F.col("other")).alias("i"))).alias("m"))
    return pages.select("id").join(best, "id", "left").select("id", (-F.col("m.i")).alias("other"), F.col("m.cosine").alias("cosine"))


@F.pandas_udf(StringType())
def plain_script(code: pd.Series) -> pd.Series:
    """Scripts with escapes and base64 calls read, and joined literals put together, in at most ten passes."""
    import base64

    def read64(m: re.Match) -> str:
        try:
            return '"' + base64.b64decode(m.group(2), validate=True).decode("utf-8") + '"'
        except ValueError:
            return m.group(0)

    def one(text):
        if text is None:
            return None
        for _ in range(10):
            new = re.sub(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1) or m.group(2), 16)), text)
            new = re.sub(r"atob\(\s*([\"'])([A-Za-z0-9+/=]+)\1\s*\)", read64, new)
            new = re.sub(r"([\"'])([^\"'\\\n]*)\1\s*\+\s*\1([^\"'\\\n]*)\1", r"\1\2\3\1", new)
            if new == text:
                break
            text = new
        return text

    return code.map(one)


def script_disguise(code: Column) -> Column:
    return (
        F.when(code.rlike(r"eval\(function\(p,a,c,k"), "packer").when(code.rlike(r"_0x[0-9a-f]{4,}"), "renamed")
        .when(code.rlike(r"(\\x[0-9a-fA-F]{2}){4,}"), "hex").when(code.rlike(r"(\\u[0-9a-fA-F]{4}){4,}"), "unicode").when(code.contains("atob("), "base64").otherwise("none")
    )


def page_value(links: Column, forms: Column, apis: Column, status: Column) -> Column:
    """50, and 20 for APIs, 15 for forms, 10 or 5 for links, more or less by status; 0 to 100."""
    s = 50 + F.when(apis > 0, 20).otherwise(0) + F.when(forms > 0, 15).otherwise(0) + F.when(links > 10, 10).when(links > 0, 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), s + F.when(status == 200, 5).when(status >= 400, -30).otherwise(0)))


def parameter_names(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """page_id, name: parameters named in addresses, form fields and links."""
    h = F.col(html)
    names = F.array_distinct(F.concat(
        extract.all_of(F.col(url), r"[?&]([A-Za-z0-9_\-]+)="), extract.all_of(h, r"(?i)<(?:input|select|textarea)\b[^>]*?\bname\s*=\s*[\"']([^\"']+)[\"']"),
        extract.all_of(h, r"[?&]([A-Za-z0-9_\-]+)="),
    ))
    return pages.select("page_id", F.explode(names).alias("name"))
