"""What needs a page's tree: its depth, counts and structure hash, and which pages have a similar one."""

from __future__ import annotations

import hashlib
import tempfile
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Elements that hold nothing, and those that only stand in a page's head.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
IN_HEAD = {"title", "meta", "link", "base", "style", "script", "noscript"}


SIGNATURE = StructType([*(StructField(n, IntegerType()) for n in ("depth", "nodes", "links", "forms", "inputs")), StructField("struct_hash", StringType())])


class _Outline(HTMLParser):
    """(depth, tag) of every element in order. html, head and body are there whether or not they are written."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[int, str]] = [(1, "html"), (2, "head")]
        self.open: list[str] = []
        self.body = False

    def _start_body(self) -> None:
        if not self.body:
            self.body = True
            self.nodes.append((2, "body"))

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head"):
            return
        if tag == "body":
            self._start_body()
            return
        if not self.body and not (tag in IN_HEAD or self.open):
            self._start_body()
        if tag == "p" and "p" in self.open:
            self._close("p")
        self.nodes.append((3 + len(self.open), tag))
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "head":
            self.open.clear()
            self._start_body()
        elif tag in self.open:
            self._close(tag)

    def _close(self, tag: str) -> None:
        while self.open and self.open.pop() != tag:
            pass


def outline(html: str | None) -> list[tuple[int, str]]:
    parser = _Outline()
    parser.feed(html or "")
    parser.close()
    parser._start_body()
    return parser.nodes


@F.pandas_udf(SIGNATURE)
def signature(html: pd.Series) -> pd.DataFrame:
    """Depth, numbers of elements, links, forms and inputs, and the MD5 of these with the sorted tag histogram."""
    rows = []
    for text in html:
        nodes = outline(text)
        n = Counter(tag for _, tag in nodes)
        row = (max(d for d, _ in nodes), len(nodes), n["a"], n["form"], n["input"])
        names = "depth:%d,nodes:%d,links:%d,forms:%d,inputs:%d" % row
        rows.append((*row, hashlib.md5((names + "".join(f",{t}:{k}" for t, k in sorted(n.items()) if k)).encode()).hexdigest()))
    return pd.DataFrame(rows, columns=["depth", "nodes", "links", "forms", "inputs", "struct_hash"])


def similarity_statistics(pairs: DataFrame, similarity: str = "similarity") -> DataFrame:
    """One row: how many pairs, and their least, mean and greatest similarity (null without a pair)."""
    s = F.col(similarity)
    return pairs.agg(F.count("*").alias("pairs"), F.min(s).alias("least"), F.round(F.avg(s), 6).alias("mean"), F.max(s).alias("most"))


# What pages' trees are compared by, each with the same weight.
FEATURES = ["depth", "nodes", "links", "forms", "inputs"]


def feature_similarity(a: Column, b: Column) -> Column:
    """Of two signatures: the mean over FEATURES of 1 - difference / larger, 1 where both are 0."""
    parts = []
    for name in FEATURES:
        x, y = a[name], b[name]
        parts.append(F.when(F.greatest(x, y) == 0, 1.0).otherwise(1.0 - F.abs(x - y) / F.nullif(F.greatest(x, y), F.lit(0))))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / len(FEATURES)


def _kept(df: DataFrame) -> DataFrame:
    """Cut the lineage: a checkpoint in the folder that the session names (``spark.checkpoint.dir``)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def leaders(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, leader, kept): pages in the order of their id, each kept unless a kept page before it is similar; ``leader``
    is the first such page, or the page itself. ``nodes``: (id), ``pairs``: (a, b) with a < b, of at least the threshold.

    In rounds: what has no undecided neighbour before it is kept, and what has a kept one before it is not. A round
    is two joins on the open pairs alone, written to the shared folder; as many as the longest chain of similar
    pages that alternates needs. Null ids take no part, nor do pairs of other ids; ids and pairs given twice count once."""
    ids = nodes.select("id").where(F.col("id").isNotNull()).distinct()
    known = pairs.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    edges = _kept(known.select("a", "b").where(F.col("a") < F.col("b")).distinct())
    open_, kept = edges, _kept(ids.join(edges.select(F.col("b").alias("id")), "id", "left_anti"))
    gone = edges.select(F.col("b").alias("id")).limit(0)
    while True:
        hit = open_.join(kept.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        gone = _kept(gone.unionByName(hit).distinct())
        left = open_.join(gone.select(F.col("id").alias("b")), "b", "left_anti").join(gone.select(F.col("id").alias("a")), "a", "left_anti")
        left = _kept(left)
        if left.isEmpty():
            kept = ids.join(gone, "id", "left_anti")
            break
        waiting = left.select(F.col("b").alias("id")).distinct()
        kept, open_ = _kept(ids.join(gone, "id", "left_anti").join(waiting, "id", "left_anti")), left
    first = edges.join(kept.select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("_first"))
    out = ids.join(first, "id", "left").join(kept.withColumn("_kept", F.lit(True)), "id", "left")
    return out.select("id", F.coalesce(F.when(F.col("_kept").isNull(), F.col("_first")), F.col("id")).alias("leader"), F.col("_kept").isNotNull().alias("kept"))


def similar_report(found: DataFrame, analysed: Column | int, threshold: float = 0.85, most: int = 20) -> DataFrame:
    """One row, ``report``: how many pages are similar to a kept one, what that saves, and the first ``most`` of them.
    ``found``: (url, similar_to, similarity)."""
    w = F.struct(-F.col("similarity"), F.col("url"), F.col("similar_to"))
    first = found.select(w.alias("w")).orderBy("w").limit(most).agg(F.sort_array(F.collect_list("w")).alias("rows"))
    pages, n = F.lit(analysed) if isinstance(analysed, int) else analysed, F.col("n")
    lines = F.transform("rows", lambda r: F.format_string("%.1f%% %s like %s", -r["col1"] * 100, r["url"], r["similar_to"]))
    saved = F.when(pages + n > 0, n / (pages + n) * 100).otherwise(0.0)
    head = F.format_string("threshold %.1f%%, pages %d, similar %d, saved %.1f%%", F.lit(threshold * 100), pages, n, saved)
    more = F.when(n > most, F.array(F.format_string("and %d more", n - most))).otherwise(F.array().cast("array<string>"))
    one = found.agg(F.count("*").alias("n")).crossJoin(first)  # one row each
    return one.select(F.array_join(F.concat(F.array(head), lines, more), "\n").alias("report"))
