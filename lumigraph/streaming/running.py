"""Streaming forms: running counters, windows with late data, first-seen filters and incremental sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_counters(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Per micro-batch and key: rows so far, their sum and mean (state: count and sum)."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s = state.get if state.exists else (0, 0.0)
        for b in batches:
            n += len(b)
            s += float(b[value].fillna(0).sum())
        state.update((n, s))
        yield pd.DataFrame({key: [k[0]], "running_n": [n], "running_sum": [s], "running_mean": [s / n if n else None]})

    return stream.groupBy(key).applyInPandasWithState(
        step, f"{key} string, running_n bigint, running_sum double, running_mean double", "n bigint, s double", "update", GroupStateTimeout.NoTimeout
    )


def windowed(stream: DataFrame, ts: str, keys: list[str], size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("v"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))


def first_seen(stream: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows whose keys did not come before, within the time that late rows are awaited."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there in micro-batches into parquet and ends; a later call goes on where this one stopped."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def collect_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Update-mode output with the number of its micro-batch, as parquet."""

    def sink(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
