"""Streams: the same column expressions over unbounded input, with keyed state where order matters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(stream: DataFrame, key: Column, ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows whose key wasn't seen before; with a time column, keys are forgotten after the watermark."""
    keyed = stream.withColumn("_key", key)
    out = keyed.dropDuplicates(["_key"]) if ts is None else keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["_key"])
    return out.drop("_key")


def capped(stream: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most ``limit`` rows of each key over the stream's life; one counter a key is kept."""
    named = stream.withColumn("_key", key.cast("string"))
    names = stream.columns

    def count(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for p in parts:
            yield p[names].head(max(0, limit - seen))
            seen += len(p)
        state.update((min(seen, limit),))

    return named.groupBy("_key").applyInPandasWithState(count, stream.schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def moving_adjustment(stream: DataFrame, key: str, value: str, rate: float = 0.1, bound: float = 20.0) -> DataFrame:
    """(key, n, adjustment) after each micro-batch: a bounded exponential average of each key."""

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, a = state.get if state.exists else (0, 0.0)
        for p in parts:
            for x in p[value]:
                a = max(-bound, min(bound, a + (float(x) - a) * rate))
                n += 1
        state.update((n, a))
        yield pd.DataFrame({"key": [str(k[0])], "n": [n], "adjustment": [a]})

    return stream.select(F.col(key).cast("string").alias("k"), F.col(value)).groupBy("k").applyInPandasWithState(fold, "key string, n long, adjustment double", "n long, a double", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str, dims: list[str], width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Request statistics per window; an addition of this library."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width), *dims).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *dims, "n")


def filtered_lines(spark: SparkSession, source: str, target: str, keep: Column, checkpoint: str, per_batch: int = 100):
    """A running query from a folder of URL lists to a folder of those that ``keep`` (over ``value``) holds for, at most
    ``per_batch`` files a time, which bounds the rate."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_batch).text(source)
    kept = lines.select(F.trim("value").alias("value")).where((F.col("value") != "") & keep)
    return kept.writeStream.format("text").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(stream: DataFrame, order: list[str], most: int, path: str, checkpoint: str):
    """A running query that keeps the ``most`` latest rows by ``order`` as Parquet: after each micro-batch what was kept
    and what came are ranked anew. Two folders take turns, so what is read is never overwritten."""
    columns = [F.col(c).desc() for c in order]

    def keep(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch
        if number > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/{(number - 1) % 2}").unionByName(batch)
        rows.orderBy(*columns).limit(most).write.mode("overwrite").parquet(f"{path}/{number % 2}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_batches(stream: DataFrame, process, checkpoint: str):
    """A running query that hands each micro-batch and its number to ``process`` once."""
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_rate(rate: float, errors_in_row: int, successes_in_row: int, least: float = 10, most: float = 200, step: float = 10, errors: int = 5, successes: int = 50) -> float:
    """The request rate after a result: a step less after so many errors in a row, a step more after so many successes."""
    if errors_in_row and errors_in_row % errors == 0:
        return max(least, rate - step)
    return min(most, rate + step) if successes_in_row and successes_in_row % successes == 0 else rate
