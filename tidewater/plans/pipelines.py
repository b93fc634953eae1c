"""Whole flows as one plan each: enrichment of news, the event graph, historical loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import analytics, ceg, ingest, market, nlp


def enrich(news: DataFrame, sources: DataFrame, aliases: DataFrame, listed: DataFrame, spam: ingest.SpamRules | None = None) -> DataFrame:
    """News with spam verdict, kind, topics, countries and linked companies; advertising goes."""
    n = news.join(F.broadcast(sources.select("code", "trust_level")), F.col("source") == F.col("code"))
    n = n.withColumn("spam", ingest.spam(F.col("text_plain"), F.col("trust_level"), spam)).filter("not spam.is_ad")
    links = nlp.link_companies(news.select("id", "text_plain"), aliases, listed, 2)
    grouped = links.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("ticker", "confidence", "method"))).alias("companies"))
    n = n.join(grouped, F.col("id") == F.col("_id"), "left").drop("_id", "code")
    n = n.withColumn("companies", F.coalesce("companies", F.array()))
    return n.withColumn("kind", nlp.news_type(F.col("title"), F.col("text_plain"), F.size("companies"))).withColumn(
        "topics", nlp.topics(F.col("text_plain"))
    ).withColumn("countries", nlp.countries(F.col("title"), F.col("text_plain"), language=F.col("lang")))


def event_graph(events: DataFrame, news: DataFrame, sources: DataFrame, keys: list[str], least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): events with importance, and CAUSES edges with link confidence."""
    nodes = ceg.importance(events, news, sources)
    pairs = ceg.causal_pairs(events, keys, least=least)
    imp = nodes.select(F.col("id").alias("_i"), F.col("importance").alias("_v"))
    e = pairs.join(imp.withColumnsRenamed({"_i": "cause_id", "_v": "cause_importance"}), "cause_id").join(imp.withColumnsRenamed({"_i": "effect_id", "_v": "effect_importance"}), "effect_id")
    hours = (F.unix_micros("effect_ts") - F.unix_micros("cause_ts")) / 3.6e9
    from tidewater.functions import scores as S

    link = S.link_confidence(F.col("conf_prior"), S.time_factor(hours), F.col("cause_importance"), F.col("effect_importance"), F.lit(0))
    return nodes, e.withColumn("link_confidence", link)


def historical_load(old: DataFrame, new: DataFrame, events: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upserted news and the price impact of its events over the default windows."""
    from tidewater.plans import dims

    return ingest.upsert(old, new, ["id"], "pub"), market.price_impact(events, prices, {k: v for k, v in dims.IMPACT_WINDOWS.items() if k != "5d"})


def backfill_batches(news: DataFrame, sources: list[str], since: int, until: int, size: int = 50) -> DataFrame:
    """How many rows and batches a backfill of a time range has; one pass instead of paging."""
    if since >= until or until - since > 365 * 86400 or not sources:
        raise ValueError("a backfill needs sources and a range of up to a year")
    rows = analytics.between(analytics.any_of(news, "source", sources), "pub", since, until)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / size).cast("long").alias("batches"))


def draft_request(hits: DataFrame, query: str) -> DataFrame:
    """The request for a draft: headline, sources, summary of the first two results."""
    from tidewater.functions import text as T

    rows = hits.orderBy("final_position").limit(10)
    g = rows.agg(F.array_sort(F.collect_list(F.struct("final_position", "url", "text"))).alias("d"))
    return g.select(
        T.headline(F.lit(query)).alias("headline"), F.transform("d", lambda x: x["url"]).alias("sources"),
        F.left(F.array_join(F.transform(F.slice("d", 1, 2), lambda x: x["text"]), " "), F.lit(300)).alias("summary"),
    )
