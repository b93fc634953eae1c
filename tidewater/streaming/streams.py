"""Structured Streaming counterparts. Every operator also runs on a batch frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A stream of files dropped into a folder; progress is kept in the query's checkpoint."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def event_time(df: DataFrame, column: str, late: str = "30 days") -> DataFrame:
    """With a proper timestamp (watermarks refuse the zoneless type) and a watermark on streams."""
    df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df.withWatermark(column, late) if df.isStreaming else df


def windowed(df: DataFrame, column: str, width: str, slide: str | None = None, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums of value by tumbling or sliding window."""
    w = F.window(column, width, slide) if slide else F.window(column, width)
    g = df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.unix_timestamp("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, column: str, gap: str, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Counts by session of a key."""
    g = df.groupBy(F.session_window(column, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.unix_micros("w.start").alias("start"), *keys, "n")


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def retro_links(stream: DataFrame, history: DataFrame, keys: list[str], days: int = 30) -> DataFrame:
    """Late causes joined to the static events up to `days` after them."""
    h = history.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col("id").alias("effect_id"), F.col("ts").alias("effect_ts"))
    on = F.col("effect_ts").between(F.col("ts") + F.expr("interval 1 hour"), F.col("ts") + F.expr(f"interval {days} days"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_h_{k}"))
    return stream.join(h, on).select(F.col("id").alias("cause_id"), "effect_id", "ts", "effect_ts")


def upsert_sink(df: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs `merge` on every micro-batch; with idempotent merges a replayed batch changes nothing."""
    writer = df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


def notify_sink(df: DataFrame, handlers: list[Callable[[DataFrame], None]], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch to the handlers."""
    return upsert_sink(df, lambda batch, _: [h(batch) for h in handlers] and None, checkpoint)


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> None:
    """Drives a stream over all that is there into a table in memory; for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
