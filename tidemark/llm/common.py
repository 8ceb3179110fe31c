"""What the corpus operators share: intermediate tables, distributed row numbers, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How many buckets of a numbered key are summed by one task; beyond, sums of such spans are summed in turn.
SPAN = 4096
#: A key counts as heavy if it has more than this part of all rows: at most twice as many keys can be heavy.
HEAVY_PART = 10_000

_written: list[tuple[SparkSession, str]] = []
_own_dirs: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session whose executors run in the driver's own
    process may leave it unset; it gets a temporary folder, which it shares by nature. On a cluster that is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = id(spark.sparkContext)
    if key not in _own_dirs:
        _own_dirs[key] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_dirs[key]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps neither recompute it nor
    depend on the executors that made it. Written tables go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under column names c0, c1, ... that no name of an operator's own clashes with, and the name of each column."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(columns: list[str], added: list[str]) -> list[str]:
    """``columns`` but for those whose names, in any case, an operator adds."""
    return [c for c in columns if c.lower() not in {a.lower() for a in added}]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm, sc = spark._jvm, spark.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: its folder is the cluster's to clean
            return


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, rows_per_bucket: int = 4096, buckets: Column | None = None) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in ``name``.

    The rows of a key are dealt into hashed buckets, each bucket is numbered by itself and starts where the
    earlier ones of its key end, so that no task holds a whole key. A key's buckets grow with the rows; where
    there are more than SPAN, they are summed in spans, so no task sums more than SPAN of them (up to SPAN ** 2).
    Rows that are equal in all of ``order`` share a bucket and may swap numbers.
    ``buckets``: how many a row's key is dealt into, where the keys' sizes are known; otherwise all have as many.
    ``df`` is evaluated three times (give it a table that is cheap to read); keys may be null."""
    spans = buckets is not None
    if buckets is None:
        many = max(1, -(-df.count() // rows_per_bucket))
        buckets, spans = F.lit(many), many > SPAN
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), buckets))
    starts = (
        dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_k_bucket"), "_n")
    )
    names = [f"_k_{k}" for k in keys]
    before = lambda by, at: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if spans:
        starts = starts.withColumn("_span", F.floor(F.col("_k_bucket") / SPAN))
        sums = starts.groupBy(*names, "_span").agg(F.sum("_n").alias("_n")).withColumn("_base", before(names, "_span"))
        sums = sums.select(*[F.col(k).alias(f"_s{k}") for k in names], F.col("_span").alias("_s_span"), "_base")
        starts = starts.withColumn("_start", before([*names, "_span"], "_k_bucket"))
        starts = starts.join(sums, _same([(k, f"_s{k}") for k in names]) & (F.col("_span") == F.col("_s_span")))
        starts = starts.select(*names, "_k_bucket", (F.col("_base") + F.col("_start")).alias("_start"))
    else:
        starts = starts.withColumn("_start", before(names, "_k_bucket")).drop("_n")
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = dealt.withColumn("_row", F.row_number().over(within) - 1)
    return (
        rows.join(starts, _same([(k, f"_k_{k}") for k in keys]) & (F.col("_bucket") == F.col("_k_bucket")), "left")
        .withColumn(name, (F.col("_start") + F.col("_row")).cast("long"))
        .drop("_bucket", "_row", "_start", "_k_bucket", *names)
    )


def _same(pairs: list[tuple[str, str]]) -> Column:
    """Whether each pair of columns is equal; nulls equal nulls."""
    return reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def join_small(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined to ``per_key`` (one row a key, with the number ``count`` of its rows). Keys with more than a
    HEAVY_PART-th of the ``total`` rows are at most HEAVY_PART, whatever the input, so they are broadcast; all
    other keys are shuffled, none of which is large for a task."""
    heavy = F.col(count) * HEAVY_PART > total
    few = F.broadcast(per_key.where(heavy).drop(count).withColumn("_heavy", F.lit(True)))
    split = rows.join(few, key, "left")
    rest = split.where("_heavy is null").select(*rows.columns).join(per_key.where(~heavy).drop(count), key)
    return split.where("_heavy").drop("_heavy").unionByName(rest)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges``: (node, component), component being the smallest node.

    Alternating large-star and small-star rounds: every node points its neighbours to the smallest one it
    knows, until only stars are left; rounds grow with the logarithm of a component's size. Before the rounds
    each task replaces the edges it holds by stars. Minima are pre-aggregated and joined back by ``join_small``,
    so a node with very many links is gathered in no task.
    Loops and repeated edges are allowed; nodes without an edge are not returned."""
    e = cut(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
        .mapInArrow(_stars, "u long, v long").distinct()
    )

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())

    was = state(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")))
        large = join_small(both.where("v > u"), least, "u", "c", 2 * was[0])
        large = cut(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        kept = join_small(large, least, "u", "c", 2 * was[0])
        small = (
            kept.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        )
        e = cut(small)
        now = state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _stars(batches):
    """The edges (u, v) of a task, some 200,000 at a time, as stars around the least node that each reaches in them."""
    import pyarrow as pa

    def star(part: list) -> pa.RecordBatch:
        t = pa.Table.from_batches(part)
        u, v = t.column("u").to_numpy(), t.column("v").to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = union(np.arange(len(nodes)), at[: len(u)], at[len(u) :])
        linked = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["u", "v"])

    waiting: list = []
    for b in batches:
        waiting.append(b)
        if sum(x.num_rows for x in waiting) >= 200_000:
            yield star(waiting)
            waiting = []
    if waiting:
        yield star(waiting)


def whole_runs(batches, keys: list[str]):
    """Arrow tables of the stream ``batches`` (dealt by ``keys`` and sorted by them) in which no run of equal keys
    is broken: what a batch ends with waits for the next."""
    import pyarrow as pa
    import pyarrow.compute as pc

    waiting: list = []

    def ends(t):
        return [t.column(k)[t.num_rows - 1] for k in keys]

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if waiting and ends(waiting[-1]) == ends(t):
            waiting.append(t)
            continue
        same = None
        for k in keys:
            x = pc.equal(t.column(k), t.column(k)[t.num_rows - 1])
            same = x if same is None else pc.and_(same, x)
        cut_at = pc.index(same, True).as_py()  # sorted: the last run begins where its keys first stand
        head = pa.concat_tables([*waiting, t.slice(0, cut_at)]) if waiting or cut_at else None
        if head is not None and head.num_rows:
            yield head.combine_chunks()
        waiting = [t.slice(cut_at)]
    if waiting:
        yield pa.concat_tables(waiting).combine_chunks()


def settle(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id reaches. ``members``: (id, cls) with cls one of the class's
    ids; ``edges``: (a, b) between classes. An id in several classes joins them."""
    of = components(edges, "a", "b")
    found = members.join(of, F.col("cls") == F.col("node"), "left").select("id", F.coalesce("component", "cls").alias("comp")).distinct()
    found = cut(found)
    several = found.groupBy("id").agg(F.count("*").alias("c"), F.min("comp").alias("low")).where("c > 1")
    bridges = components(found.join(several, "id").select("comp", "low"), "comp", "low")
    found = found.join(bridges, F.col("comp") == F.col("node"), "left").select("id", F.coalesce("component", "comp").alias("comp")).distinct()
    found = cut(found)
    least = found.groupBy("comp").agg(F.min("id").alias("component"), F.count("*").alias("c"))
    return join_small(found, least, "comp", "c", found.count()).select("id", "component")


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (least positions) after uniting the pairs (a, b)."""
    while len(a):
        ra, rb = parent[a], parent[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        live = low < high
        if not live.any():
            break
        np.minimum.at(parent, high[live], low[live])
        while True:
            nxt = parent[parent]
            if (nxt == parent).all():
                break
            parent = nxt
        a, b = a[live], b[live]
    return parent


def give_back() -> None:
    """Return a Python worker's freed memory to the system at a task's end: workers live on for other tasks."""
    gc.collect()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
