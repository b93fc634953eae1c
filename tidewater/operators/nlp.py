"""Rule-based extraction, classification and linking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import scores as S
from tidewater.functions import text as T
from tidewater.functions import udfs
from tidewater.plans import dims
from tidewater.plans.joins import FIRST_WORDS, ngram_join


def _first(pairs: Sequence[tuple[str, list[str]]], x: Column, rest: Column) -> Column:
    """The name of the first pair that has a word in the text."""
    out = rest
    for name, words in reversed(list(pairs)):
        out = F.when(T.any_word(x, words), name).otherwise(out)
    return out


def news_type(title: Column, text: Column, companies: Column, market: Sequence[str] | None = None, regulatory: Sequence[str] | None = None) -> Column:
    """struct<news_type, news_subtype, confidence, is_market_wide, is_regulatory>: one
    company first, then market words, then regulatory ones; some subtypes win over all."""
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    none = F.lit(None).cast("string")
    one = companies == 1
    is_market = ~one & T.any_word(low, market or dims.MARKET_WORDS)
    is_reg = ~one & ~is_market & T.any_word(low, regulatory or dims.REGULATORY_WORDS)
    base = F.when(one, _first(dims.SUBTYPES_ONE_COMPANY, low, none)).when(is_reg & T.any_word(low, dims.SANCTION_WORDS), "sanctions").otherwise(none)
    return F.struct(
        F.when(one, "one_company").when(is_market, "market").when(is_reg, "regulatory").alias("news_type"), _first(dims.SUBTYPES_OVERRIDE, low, base).alias("news_subtype"),
        F.when(one, 0.8).when(is_market, 0.7).when(is_reg, 0.9).otherwise(0.0).alias("confidence"), is_market.alias("is_market_wide"), is_reg.alias("is_regulatory"),
    )


def _all(pairs, x: Column) -> Column:
    return F.array_compact(F.array(*[F.when(T.any_word(x, words), F.lit(name)) for name, words, *_ in pairs]))


def tags(title: Column, text: Column, words: Sequence | None = None) -> Column:
    """All tags whose words occur."""
    return _all(words or dims.TAG_WORDS, F.lower(F.concat_ws(" ", title, text)))


def topics(text: Column, words: Sequence | None = None) -> Column:
    """array<struct<topic, confidence>> of the simple topics."""
    low = F.lower(text)
    hits = [F.when(T.any_word(low, w), F.struct(F.lit(n).alias("topic"), F.lit(c).alias("confidence"))) for n, w, c in (words or dims.TOPIC_WORDS)]
    return F.array_compact(F.array(*hits))


def countries(title: Column, text: Column, places: Column | None = None, language: Column | None = None) -> Column:
    """Countries that title, text or places name, and the language's, sorted."""
    out = F.array_union(T.countries_in(F.coalesce(text, F.lit(""))), T.countries_in(F.coalesce(title, F.lit(""))))
    if places is not None:
        out = F.array_union(out, F.flatten(F.transform(places, T.countries_in)))
    if language is not None:
        out = F.array_union(out, F.array_compact(F.array(T.country_of_language(language))))
    return F.array_sort(out)


def is_regulator(name: Column, context: Column, patterns: dict[str, list[str]], needed: dict[str, list[str]] | None = None) -> Column:
    """Whether an organisation's name contains a regulator's; some only count beside words of their field."""
    low, around, out = F.lower(name), F.lower(context), F.lit(False)
    for key, words in patterns.items():
        hit = T.any_word(low, words)
        out = out | (hit & T.any_word(around, needed[key]) if needed and key in needed else hit)
    return out


def sector_of_ticker(ticker: Column) -> Column:
    return S.lookup(ticker, dims.TICKER_SECTOR, None)


def sector_of_words(words: Column) -> Column:
    """The sector of the first word that contains a known keyword."""
    hits = F.transform(words, lambda w: _first(dims.KEYWORD_SECTOR, F.lower(w), F.lit(None).cast("string")))
    return F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0))


def sector_mode(rows: DataFrame, key: str, sector: str) -> DataFrame:
    """The most frequent sector of each key, the second, and the first's share; ties by name."""
    n = rows.filter(F.col(sector).isNotNull()).groupBy(key, sector).agg(F.count(F.lit(1)).alias("n"))
    ranked = n.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(sector).alias("s")))).alias("r"), F.sum("n").alias("all"))
    return ranked.select(key, F.get("r", F.lit(0))["s"].alias("primary"), F.get("r", F.lit(1))["s"].alias("secondary"), F.round(-F.get("r", F.lit(0))["n"] / F.col("all"), 6).alias("confidence"))


def event_types(title: Column, text: Column, markers: dict[str, list[str]] | None = None, limit: int = 2, general: str = "news_general") -> Column:
    """array<struct<event_type, hits, confidence>>: the `limit` types of highest priority whose
    markers occur, in order of declaration among equals; news_general without any."""
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    found = []
    for place, (name, words) in enumerate((markers or dims.EVENT_MARKERS).items()):
        hits = F.regexp_count(low, F.lit("|".join(_quoted(w) for w in words)))
        found.append(F.when(hits > 0, F.struct(F.lit(-dims.EVENT_PRIORITY.get(name, dims.DEFAULT_PRIORITY)).alias("p"), F.lit(place).alias("o"), F.lit(name).alias("t"), hits.alias("h"))))
    best = F.slice(F.array_sort(F.array_compact(F.array(*found))), 1, limit)
    out = F.transform(best, lambda s: F.struct(s["t"].alias("event_type"), s["h"].cast("int").alias("hits"), S.clip(0.7 + F.least(s["h"] * 0.1, F.lit(0.2)), 0.5, 0.95).alias("confidence")))
    none = F.array(F.struct(F.lit(general).alias("event_type"), F.lit(0).alias("hits"), F.lit(0.7).alias("confidence")))
    return F.when(F.size(out) > 0, out).otherwise(none)


def _quoted(word: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\&" else c for c in word)


def extract_events(news: DataFrame, markers: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each event of a news item; columns companies and metrics, if any, make anchors."""
    types = event_types(F.col("title"), F.col("text_plain"), markers)
    e = news.select("*", F.explode(types).alias("_e")).select(*news.columns, "_e.*")
    anchor = F.col("event_type").isin(dims.ANCHOR_TYPES)
    if "companies" in news.columns:
        anchor = anchor | (F.size("companies") >= 2)
    if "metrics" in news.columns:
        anchor = anchor | (F.size("metrics") >= 1)
    return e.withColumn("is_anchor", anchor)


def link_companies(news: DataFrame, aliases: DataFrame, listed: DataFrame, longest: int = 3, organisations: DataFrame | None = None) -> DataFrame:
    """(id, ticker, confidence, method): tickers written out (1.0), then organisations that were
    recognised, as of resolve_names(), then aliases of up to `longest` words (0.95); the first of
    these passes that has a ticker counts. aliases: alias, ticker; listed: ticker and what
    resolve_names() compares; organisations: id, name. Only listed tickers are linked."""
    words = F.filter(F.split(F.lower("text_plain"), r"(?U)\W+"), lambda w: w != "")
    tickers = listed.select("ticker").distinct()
    written, known = T.ticker_tokens(F.col("text_plain")), tickers.limit(FIRST_WORDS + 1).collect()
    if len(known) <= FIRST_WORDS:  # most words look like tickers once they are in capitals
        written = F.filter(written, lambda t: t.isin([r.ticker for r in known]))
    passes = [news.select("id", F.explode(written).alias("ticker")).join(tickers, "ticker", "left_semi").select("id", "ticker", F.lit(1.0).alias("confidence"), F.lit("ticker").alias("method"))]
    if organisations is not None:
        passes.append(organisations.join(resolve_names(organisations.select("name"), aliases, listed), "name").select("id", "ticker", "confidence", "method"))
    by_name = ngram_join(news, "id", words, aliases.join(tickers, "ticker", "left_semi").select("alias", "ticker"), "alias", longest)
    passes.append(by_name.select("id", "ticker", F.lit(0.95).alias("confidence"), F.lit("alias").alias("method")))
    out = None
    for i, found in enumerate(passes):
        found = found.withColumn("pass", F.lit(i))
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("id", "ticker").agg(F.min(F.struct("pass", (-F.col("confidence")).alias("less"), "method")).alias("b"))
    return best.select("id", "ticker", (-F.col("b.less")).alias("confidence"), "b.method")


def resolve_names(names: DataFrame, aliases: DataFrame, securities: DataFrame, least: float = 0.7, cached: DataFrame | None = None) -> DataFrame:
    """Organisation names (name) to tickers (name, ticker, confidence, method), by the first step that has one:
    cached (clean, ticker, confidence, method); known_alias (0.95) of a listed ticker; auto_learned (0.85),
    the security with most points of listing_score(), 50 or more; search, the most similar one, 1.2 times if traded
    and 1.1 times on the main board, above `least`; fuzzy, sorted words alike to 0.8, 0.9 times its similarity.

    securities: ticker, title, and full, isin, traded, kind, board if known. Candidates share the first three
    letters of a word with the name, so the comparison is an equi-join, not a cross join; points go to candidates only.
    """
    have = securities.columns
    n = names.select("name", T.company_name(F.col("name")).alias("clean")).distinct()
    tickers = securities.select("ticker").distinct()
    exact = n.join(aliases.join(tickers, "ticker", "left_semi"), F.col("clean") == F.col("alias"))
    steps = [exact.select("name", F.lit(1).alias("step"), F.lit(0.95).alias("score"), "ticker", F.lit(0.95).alias("confidence"), F.lit("known_alias").alias("method"))]
    if cached is not None:
        steps.append(n.join(cached, "clean").select("name", F.lit(0).alias("step"), F.lit(1.0).alias("score"), "ticker", "confidence", "method"))
    column = lambda c, default: F.col(c) if c in have else F.lit(default)
    s = securities.select(
        "ticker", "title", column("full", None).cast("string").alias("full"), column("isin", None).cast("string").alias("isin"), column("traded", False).alias("traded"),
        column("kind", None).cast("string").alias("kind"), column("board", None).cast("string").alias("board"),
    ).withColumns({"short_name": T.company_name(F.col("title")), "full_name": T.company_name(F.coalesce("full", F.lit("")))})
    heads = lambda x: F.explode(F.array_distinct(F.transform(F.filter(F.split(x, " "), lambda w: w != ""), lambda w: F.left(w, F.lit(3)))))
    pairs = n.withColumn("w", heads(F.col("clean"))).join(s.withColumn("w", heads(F.concat_ws(" ", "short_name", "full_name"))), "w").drop("w").distinct()
    points = T.listing_score(F.col("clean"), F.col("title"), F.col("full"), F.col("isin"), F.col("traded"), F.col("kind"), F.col("board"))
    pairs = pairs.withColumn("points", points).withColumns({"a": udfs.name_similarity(F.col("clean"), F.col("short_name")), "b": udfs.name_similarity(F.col("clean"), F.col("full_name"))})
    boost = F.when(F.col("traded"), 1.2).otherwise(1.0) * F.when(F.col("board") == "main", 1.1).otherwise(1.0)
    found = F.col("a.similarity") * boost
    alike = F.greatest(*[F.when(F.col(f"{x}.words") >= 0.8, F.col(f"{x}.similarity")).otherwise(0.0) for x in "ab"])
    row = lambda step, ok, score, confidence, method: F.when(ok, F.struct(F.lit(step).alias("step"), score.cast("double").alias("score"), "ticker", confidence.alias("confidence"), F.lit(method).alias("method")))
    # one row for each candidate and step that takes it, so names are compared once
    taken = F.array_compact(F.array(
        row(2, F.col("points") >= 50, F.col("points"), F.lit(0.85), "auto_learned"),
        row(3, found > least, found, F.least(found, F.lit(1.0)), "search"),
        row(4, alike > least, alike, alike * 0.9, "fuzzy"),
    ))
    steps.append(pairs.select("name", F.explode(taken).alias("x")).select("name", "x.*"))
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    best = out.groupBy("name").agg(F.min(F.struct("step", (-F.col("score")).alias("less"), "ticker", "confidence", "method")).alias("b"))
    return best.select("name", "b.ticker", "b.confidence", "b.method")


def resolve_spans(spans: Column) -> Column:
    """Spans struct<start, stop, confidence> without overlaps: by start, of two that overlap the surer stays."""
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] > s["start"]),
        F.when(F.element_at(acc, -1)["confidence"] >= s["confidence"], acc).otherwise(F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(s))),
    ).otherwise(F.concat(acc, F.array(s)))
    ordered = F.array_sort(spans)
    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def signals(label: Column, score: Column, text: Column, companies: Column, urgent: Sequence[str]) -> Column:
    """array<struct<company, signal, confidence>> of trading signals."""
    alarm = T.any_word(F.lower(text), list(urgent))
    sell = (label == "NEGATIVE") & (score > 0.9)
    one = lambda c: F.struct(c.alias("company"), F.when(alarm, "URGENT_SELL").otherwise("SELL").alias("signal"), F.when(alarm, 0.95).otherwise(score).alias("confidence"))
    return F.when(alarm | sell, F.transform(companies, one)).otherwise(F.slice(F.transform(companies, one), 1, 0))


def sentiment(text: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """struct<label, score> by counts of words of two lists."""
    words = T.word_set(text)
    p = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in positive])))
    n = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in negative])))
    return F.struct(F.when(p > n, "POSITIVE").when(n > p, "NEGATIVE").otherwise("NEUTRAL").alias("label"), F.coalesce(F.try_divide(F.greatest(p, n), p + n), F.lit(0.0)).alias("score"))


def numbered(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """Positions within a result that fits a page."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def sector_tree(spark, taxonomy: str = "icb") -> DataFrame:
    """(code, name, level, root, path) of a taxonomy, by a recursive query over parents."""
    spark.createDataFrame(dims.TAXONOMIES[taxonomy], "code string, name string, parent string").createOrReplaceTempView("_sectors")
    return spark.sql("""
        WITH RECURSIVE t AS (
          SELECT code, name, 1 AS level, code AS root, code AS path FROM _sectors WHERE parent IS NULL
          UNION ALL SELECT s.code, s.name, t.level + 1, t.root, concat(t.path, '/', s.code) FROM _sectors s JOIN t ON s.parent = t.code)
        SELECT * FROM t""")


def entities(text: Column, companies: dict[str, tuple[str, str]] | None = None, markets: dict[str, str] | None = None, metrics: dict[str, str] | None = None) -> Column:
    """struct<companies, markets, financial_metrics>: the built-in extractor, from dictionaries
    and number patterns. A model takes its place as any function of a column."""
    words = F.transform(T.word_set(text), lambda w: F.upper(w))
    companies, markets, metrics = companies or dims.GLOSSARY_COMPANIES, markets or dims.GLOSSARY_MARKETS, metrics or dims.METRIC_WORDS
    has = lambda name: F.array_contains(words, name.upper())
    found = [F.when(has(n), F.struct(F.lit(n).alias("name"), F.lit(t).alias("ticker"), F.lit(s).alias("sector"))) for n, (t, s) in companies.items()]
    places = [F.when(has(n), F.struct(F.lit(n).alias("name"), F.lit(k).alias("type"))) for n, k in markets.items()]
    low, sums = F.lower(text), T.money(text)
    kinds = F.array_compact(F.array(*[F.when(low.contains(stem), F.lit(name)) for stem, name in metrics.items()]))
    return F.struct(
        F.array_compact(F.array(*found)).alias("companies"), F.array_compact(F.array(*places)).alias("markets"),
        F.transform(kinds, lambda k: F.struct(k.alias("metric_type"), F.get(sums, F.lit(0))["amount"].alias("value"))).alias("financial_metrics"),
    )
