"""The corpus pipeline: quality, toxicity, near-duplicates, mixing, packing, each over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_texts, packing, quality, toxicity
from tidemark.llm.common import cut, fresh, masked, table
from tidemark.llm.queries import QUALITY_AT, TOXIC_AT, vocabulary_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier does not reject, unchanged, null and empty texts judged like others."""
    score = fresh("_score", docs.columns)
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), column=score)
    return scored.where(F.col(score) >= QUALITY_AT).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the toxicity classifier does not reject, unchanged, null and empty texts judged like others."""
    score = fresh("_score", docs.columns)
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), column=score)
    return scored.where(F.col(score) < TOXIC_AT).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest doc_id; rows without words all stay.
    Every row is a document of its own here, whether or not it has an id or shares one."""
    inner, name = masked(docs)
    order = [F.col(name["doc_id"]).asc_nulls_last(), F.crc32(F.coalesce(F.col(name["text"]), F.lit("")))]
    rows = cut(inner.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    kept = near_texts.near_duplicates(rows, id_col="_row", text=name["text"]).where("kept").select("_row")
    return rows.join(kept, "_row", "left_semi").select(*inner.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and pass over its source, with the words that the mix takes of it; every other column is
    the row's own (n_chars is counted again). Rows without words are not taken."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row and their places in sequences."""
    return packing.pack_documents(docs, vocabulary_path(), 2048)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn to ``documents``; each result but the last is written before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
