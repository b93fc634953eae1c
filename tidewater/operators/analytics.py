"""Relational analytics over news, events, scores, watches and messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_of(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Rows whose value is listed; all rows without a list."""
    return df if not values else df.filter(F.col(column).isin(list(values)))


def between(df: DataFrame, column: str, since=None, until=None) -> DataFrame:
    """Rows from `since` to `until`, both optional and inclusive."""
    if since is not None:
        df = df.filter(F.col(column) >= since)
    return df if until is None else df.filter(F.col(column) <= until)


def containing(df: DataFrame, columns: Sequence[str], words: str | None) -> DataFrame:
    """Rows where any column contains the words in any case; % and _ mean themselves."""
    if not words:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(words.lower())
    return df.filter(hit)


def having(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows with a partner: a semi join, so several partners don't repeat a row."""
    return df.join(other.select(F.col(other_key).alias("_other")), F.col(key) == F.col("_other"), "left_semi")


def lacking(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows without a partner."""
    return df.join(other.select(F.col(other_key).alias("_other")), F.col(key) == F.col("_other"), "left_anti")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of an ordered result; the order must end with a unique key."""
    df = df.orderBy(*order)
    return (df.offset(offset) if offset else df).limit(limit)


def search_news(
    news: DataFrame, sources: Sequence[str] | None = None, words: str | None = None, since: int | None = None, until: int | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """News by source, time and words, newest first."""
    rows = containing(between(any_of(news, "source", sources), "pub", since, until), ["title", "text_plain"], words)
    return page(rows, [F.col("pub").desc(), F.col("id")], limit, offset)


def latest_per_key(df: DataFrame, key: str, when: str) -> DataFrame:
    """The row of each key with the greatest time; one aggregation, no window sort."""
    rest = [c for c in df.columns if c not in (key, when)]
    best = F.max(F.struct(when, *rest))
    return df.groupBy(key).agg(best.alias("_b")).select(key, F.col(f"_b.{when}").alias(when), *[F.col(f"_b.{c}").alias(c) for c in rest])


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; row_number <= k is pruned before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def score_summary(scores: DataFrame, value: str) -> DataFrame:
    """Count, mean, extremes and sample deviation; zero instead of null."""
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return scores.agg(
        F.count(F.lit(1)).alias("n"), zero(F.avg(value)).alias("mean"), zero(F.max(value)).alias("highest"), zero(F.min(value)).alias("lowest"), zero(F.stddev_samp(value)).alias("deviation")
    )


def top_groups(df: DataFrame, key: str, value: str, k: int = 10) -> DataFrame:
    """Keys with the highest mean, ties by name."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return g.orderBy(F.col("mean").desc(), key).limit(k)


def daily_trend(df: DataFrame, day: Column, value: str) -> DataFrame:
    """Count, mean and maximum by day."""
    return df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.max(value), 6).alias("highest"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal bins from the least to the greatest value, closed on the right, the first on
    both sides; with one value all rows are in the first. Empty bins are listed."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.greatest(F.least(F.ceil((F.col(value) - F.col("lo")) / F.nullif(width, F.lit(0.0))).cast("int"), F.lit(bins)), F.lit(1)))
    filled = df.select(value).join(F.broadcast(ends)).select(at.alias("bin"), "lo", "hi", "total").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    all_bins = ends.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("b"), "lo", width.alias("w"), "total")
    return all_bins.join(filled, F.col("b") == F.col("bin"), "left").select(
        F.col("b").alias("bin"), F.round(F.col("lo") + (F.col("b") - 1) * F.col("w"), 6).alias("from"), F.round(F.col("lo") + F.col("b") * F.col("w"), 6).alias("to"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(100.0 * F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("percent"),
    )


def bundle(parent: DataFrame, child: DataFrame, key: str, child_key: str, fields: Sequence[str], out: str) -> DataFrame:
    """parent with an ordered array of its children; empty without any."""
    kids = child.groupBy(child_key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))
    joined = parent.join(kids, parent[key] == kids[child_key], "left").drop(kids[child_key])
    return joined.withColumn(out, F.coalesce(out, F.array()))


def watch_stats(watches: DataFrame) -> DataFrame:
    """Per level: watches, distinct events and rules, share notified."""
    return watches.groupBy("watch_level").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events"), F.countDistinct("rule_id").alias("rules"),
        F.round(F.avg((F.col("status") == "notified").cast("int")), 6).alias("notified"),
    )


def expire(watches: DataFrame, now: int, hours: int = 168) -> DataFrame:
    """Triggered watches of that age become expired; times in microseconds."""
    old = (F.col("status") == "triggered") & (F.col("triggered") <= now - hours * 3_600_000_000)
    return watches.withColumn("status", F.when(old, "expired").otherwise(F.col("status")))


def status_counts(messages: DataFrame, limit: int = 3) -> DataFrame:
    """Messages by status, and those that failed for good."""
    return messages.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("status") == "failed") & (F.col("retry_count") >= limit)).alias("given_up"))


def eligible(messages: DataFrame, now: int, limit: int = 100, attempts: int = 3) -> DataFrame:
    """Messages to send: pending, or failed with attempts left whose time has come; oldest first."""
    due = F.col("next_retry").isNull() | (F.col("next_retry") <= now)
    rows = messages.filter((F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("retry_count") < attempts) & due))
    return page(rows, [F.col("created"), F.col("id")], limit)


def signed_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, extremes and counts by sign."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.max(value), 6).alias("highest"), F.round(F.min(value), 6).alias("lowest"),
        F.count_if(F.col(value) > 0).alias("positive"), F.count_if(F.col(value) < 0).alias("negative"),
    )


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def length_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    n = F.length(text)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


def cube_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts and sums at all levels of a rollup."""
    return df.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
