"""Sharding: a hierarchical weighted hash tree (region, rack, shard).

At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the child's name and the row's
key; the least draw wins and the row goes down into that child. A child's draw depends on nothing but itself
and its own weight, so a weight that changes moves rows only into or out of the subtrees on its path; and a
shard that opens a subtree of its own takes rows only into itself.

Null keys are one key. Rows, nulls and copies alike, are all placed; rows that are equal in the key and in ``order``
may swap slots. Only the key decides, so texts of any length cost the same. An empty table gives an empty one. The
input's columns are kept, but for ``shard``, ``slot`` and (with a grown tree) ``grown_shard``, which must not stand in it: that raises."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, numbered


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, regions: int = 4, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """The first regions * racks * per_rack shards fill a regular tree; each later one opens its own region,
    which is why growth by one shard moves rows only into that shard. Fewer shards than the regular tree has would
    need another tree, to which rows would move from everywhere: that raises. Found a small cluster on a smaller
    tree (1, 1, 1 for any number of shards) and keep its three numbers as it grows."""
    base = regions * racks * per_rack
    if base < 1 or shards < base:
        raise ValueError(f"{shards} shards are fewer than the {base} of the tree that they start from")
    return [
        Leaf(f"r{i // (racks * per_rack)}", f"k{i // per_rack % racks}", i) if i < base else Leaf(f"x{i}", "k0", i)
        for i in range(shards)
    ]


def _uniform(name: str, key: Column, seed: int) -> Column:
    """In (0, 1]: 53 bits of a hash of the node's name and the key."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), F.lit(seed), key), 11)
    return (bits.cast("double") + 1.0) / float(2**53)


def _descend(leaves: list[Leaf], key: Column, seed: int, levels: tuple[str, ...] = ("region", "rack"), path: str = "") -> Column:
    of = levels[0] if levels else "shard"
    children: dict = {}
    for x in leaves:
        children.setdefault(getattr(x, of), []).append(x)
    def below(name: object, own: list[Leaf]) -> Column:
        if levels:
            return _descend(own, key, seed, levels[1:], f"{path}/{name}")
        return F.lit(own[0].shard)

    names = sorted(children, key=str)
    if len(names) == 1:
        return below(names[0], children[names[0]])
    draws = [
        F.struct((-F.log(_uniform(f"{path}/{n}", key, seed)) / F.lit(sum(x.weight for x in children[n]))).alias("draw"), F.lit(i).alias("i"))
        for i, n in enumerate(names)
    ]
    won = F.array_min(F.array(*draws))["i"]
    out = F.when(won == 0, below(names[0], children[names[0]]))
    for i, n in enumerate(names[1:], 1):
        out = out.when(won == i, below(n, children[n]))
    return out


def place(key: Column, leaves: list[Leaf], seed: int = 17) -> Column:
    """The shard (int) that the tree gives to ``key``. Leaves of weight 0 or less take nothing."""
    live = [x for x in leaves if x.weight > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    if len({x.shard for x in live}) != len(live):
        raise ValueError("a shard is listed twice")
    return _descend(live, key, seed).cast("int")


def shard_rows(df: DataFrame, key: str, leaves: list[Leaf], grown: list[Leaf] | None = None, order: list[str] = (), seed: int = 17) -> DataFrame:
    """``df`` with ``shard``, ``slot`` (its gapless place in the shard, from 0) and, given a ``grown`` tree,
    ``grown_shard``. ``df`` is written once to the shared folder, so keep its columns narrow."""
    if taken := {"shard", "slot", *(["grown_shard"] if grown is not None else [])} & {c.lower() for c in df.columns}:
        raise ValueError(f"the table has columns of the names {sorted(taken)} already")
    out = df.withColumn("shard", place(F.col(key), leaves, seed))
    if grown is not None:
        out = out.withColumn("grown_shard", place(F.col(key), grown, seed))
    return numbered(cut(out), ["shard"], [F.col(key), *map(F.col, order)], "slot")
