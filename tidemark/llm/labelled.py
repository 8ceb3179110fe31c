"""Bounded training samples: which rows may teach, and how they are fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from: a fifth, by the CRC-32 of the id as text (a null id: held out)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int, max_unlabelled: int = 0, each: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, label): of the rows that aren't held out, at most ``max_labelled`` labelled ids that have a document
    (of either label as many, with ``each``) and, with a null label, ``max_unlabelled`` ids of any documents, each the first by a hash of
    the id. One row an id: of rows that share one, the least text; an id that is labelled both ways teaches nothing.

    Ids are fetched first, so that texts are read for the sample only; the ids that are broadcast are at most as
    many as the bounds together."""

    def free(df: DataFrame, *more: str) -> DataFrame:
        return df.where(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(doc_id).alias("id"), *more)

    known = free(labels, label).where(F.col(label).isin(0, 1)).groupBy("id").agg(F.min(label).cast("int").alias("label"), F.max(label).alias("_most"))
    known = known.where("label = _most").drop("_most").join(free(docs), "id", "left_semi")
    parts = [known.where(F.col("label") == y) for y in (0, 1)] if each else [known]
    some = free(docs).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(max_unlabelled).distinct()
    ids = some.select("id", F.lit(None).cast("int").alias("label")) if max_unlabelled else None
    for part in parts:
        part = part.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
        ids = part if ids is None else ids.unionByName(part)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    return rows.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")
