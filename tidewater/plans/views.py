"""Domain views over the star-schema tables, and the same views in SQL.

Times are epoch seconds (`pub`) or microseconds (`us`) beside timestamps, so both
engines compare whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.plans import dims
from tidewater.session import spread

TYPES = {"error": "sanctions", "click": "earnings_miss", "view": "regulatory", "purchase": "m&a", "signup": "rate_hike"}
START = 1704067200
TICKERS = ["GAZP", "LKOH", "ZZZZ", "SBER"]
ORGANISATIONS = ["ПАО Сбербанк России", "Газпром нефть", "Lukoil Holding", "Завод Роснефти", "Роснефь банк"]
SECURITIES = [
    ("SBER", "Сбербанк", "ПАО Сбербанк", "RU0009029540", True, "shares", "main"), ("GAZP", "Газпром", "ПАО Газпром", "RU0007661625", True, "shares", "main"),
    ("LKOH", "Лукойл", "ПАО Лукойл", "RU0009024277", True, "shares", "main"), ("ROSN", "Роснефть", "ПАО Роснефть", None, True, None, None),
    ("BSPB", "Роснефть банк", None, None, False, None, None), ("YNDX", "Яндекс", "Яндекс НВ", "NL0009805522", False, "shares", None),
]


def mentions(head: str, who: tuple, base: int, k) -> Column:
    """Names that an event has: that of its user moved by each shift whose divisor divides k."""
    names = [F.when(k % every == 0, F.concat(F.lit(head), ((F.col("user_id") + shift) % base).cast("string"))) for shift, every in who]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


class Views:
    """Views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sources(self) -> DataFrame:
        n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
        return self.table("documents").select("source").distinct().select(
            F.col("source").alias("code"), (n % 11).alias("trust_level"), F.when(n % 2 == 0, "telegram").otherwise("html").alias("kind"), (n % 5 != 0).alias("enabled")
        )

    def news(self) -> DataFrame:
        return spread(self.table("documents")).select(
            F.col("doc_id").alias("id"), F.col("text").alias("text_plain"), T.title_of(F.col("text")).alias("title"), "lang", "source", "n_chars",
            (F.lit(START) + F.col("doc_id") * 420).alias("pub"), F.sha2("text", 256).alias("hash_content"),
        )

    def reports(self) -> DataFrame:
        """News of all languages whose text ends with a company's alias, a ticker or neither."""
        names = F.array(*[F.lit(a) for a in sorted(dims.ALIASES)])
        said = F.when(F.col("id") % 3 == 0, F.element_at(names, (F.col("id") % len(dims.ALIASES) + 1).cast("int"))).when(F.col("id") % 3 == 1, F.element_at(F.array(*[F.lit(t) for t in TICKERS]), (F.col("id") % len(TICKERS) + 1).cast("int"))).otherwise("")
        return self.news().select("id", F.concat("text_plain", F.lit(" ("), said, F.lit(").")).alias("text_plain"))

    def organisations(self) -> DataFrame:
        """Organisations that were recognised in every fifth news item."""
        return self.table("documents").select(F.col("doc_id").alias("id")).filter("id % 5 = 0").select("id", F.element_at(F.array(*[F.lit(x) for x in ORGANISATIONS]), (F.expr("id div 5") % len(ORGANISATIONS) + 1).cast("int")).alias("name"))

    def securities(self) -> DataFrame:
        return self.spark.createDataFrame(SECURITIES, "ticker string, title string, full string, isin string, traded boolean, kind string, board string")

    def aliases(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(dims.ALIASES.items()), "alias string, ticker string")

    def events(self) -> DataFrame:
        kind = F.lit("other")
        for have, means in TYPES.items():
            kind = F.when(F.col("event_type") == have, means).otherwise(kind)
        ts = F.col("ts").cast("timestamp")
        total = self.table("documents").agg(F.count(F.lit(1)).alias("n"))  # one row
        return self.table("events").join(F.broadcast(total)).select(
            F.col("event_id").alias("id"), ts.alias("ts"), F.unix_micros(ts).alias("us"), kind.alias("event_type"),
            F.concat(F.lit("T"), (F.col("user_id") % 20).cast("string")).alias("ticker"), F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("company"),
            "value", (k := F.get_json_object("props", "$.k").cast("int")).alias("k"), mentions("T", ((0, 1), (7, 3), (11, 4), (13, 5)), 20, k).alias("tickers"),
            mentions("C", ((0, 1), (1, 2), (2, 3), (3, 6), (4, 6), (5, 6), (6, 9)), 1 << 40, k).alias("companies"), (F.col("event_id") % F.col("n")).alias("news_id"), kind.isin(dims.ANCHOR_TYPES).alias("is_anchor"),
        )

    def importance(self) -> DataFrame:
        """Score histories: one version of each event, a second, lower one of every even id."""
        e = self.events().select("id", "us", "event_type", F.least(F.col("value") / 200, F.lit(1.0)).alias("s"))
        again = e.filter("id % 2 = 0").select("id", (F.col("us") + 3_600_000_000).alias("us"), "event_type", (F.col("s") * 0.9).alias("s"))
        return e.unionByName(again).select(F.col("id").alias("event_id"), F.col("us").alias("calculated"), "event_type", F.col("s").alias("importance_score"))

    def prices(self) -> DataFrame:
        day = F.to_date("l_shipdate")
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("secid"), day.alias("day")).agg(
            F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) + 1e-9, 6).alias("close"), F.sum("l_quantity").alias("volume")
        )

    def companies(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
            F.col("s_suppkey").alias("secid"), F.col("s_name").alias("name"), F.col("n_name").alias("sector"), F.col("r_name").alias("country")
        )

    def sectors(self) -> DataFrame:
        """(ticker, sector): a ticker is in the sector of the company of its number."""
        return self.companies().filter("secid < 20").select(F.concat(F.lit("T"), F.col("secid").cast("string")).alias("ticker"), "sector")

    def impacts(self) -> DataFrame:
        """IMPACTS edges (event_id, ticker, price_impact, volume_impact) of every other event, to its first two tickers."""
        e = self.events().filter("id % 2 = 0").select(F.col("id").alias("event_id"), F.posexplode(F.slice("tickers", 1, 2)).alias("pos", "ticker"), "k", "value")
        return e.select("event_id", "ticker", ((F.col("k") - 50) / (5000 + 2000 * F.col("pos"))).alias("price_impact"), (F.col("value") / 40).alias("volume_impact"))

    def watches(self) -> DataFrame:
        """A watch for each event of some importance."""
        e = self.events()
        level = F.concat(F.lit("L"), (F.col("id") % 3).cast("string"))
        status = F.when(F.col("id") % 4 == 0, "notified").when(F.col("id") % 7 == 0, "expired").otherwise("triggered")
        return e.filter("value >= 60").select(
            F.col("id").alias("event_id"), F.concat(F.lit("rule_"), F.col("event_type")).alias("rule_id"), level.alias("watch_level"), status.alias("status"),
            F.col("us").alias("triggered"), F.least(F.col("value") / 200, F.lit(1.0)).alias("importance"),
        )

    def outbox(self) -> DataFrame:
        """Messages from orders: status, attempts and times."""
        o = self.table("orders")
        status = F.when(F.col("o_orderstatus") == "F", "sent").when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("pending")
        created = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
        return o.select(
            F.col("o_orderkey").alias("id"), status.alias("status"), (F.col("o_orderkey") % 5).cast("int").alias("retry_count"), created.alias("created"),
            F.when(F.col("o_orderkey") % 4 > 0, created + (F.col("o_orderkey") % 4) * 60).alias("next_retry"),
        )

    def edges(self) -> DataFrame:
        """CAUSES edges: the supplier of a large line to that of the order's next line."""
        a = self.table("lineitem").filter("l_quantity >= 45 and l_discount >= 0.09").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("src"), "l_partkey")
        b = self.table("lineitem").select(F.col("l_orderkey").alias("o2"), (F.col("l_linenumber") - 1).alias("n2"), F.col("l_suppkey").alias("dst"))
        return a.join(b, (a.l_orderkey == b.o2) & (a.l_linenumber == b.n2)).filter("src <> dst").groupBy("src", "dst").agg(
            (F.max(F.col("l_partkey") % 60) / 100.0 + 0.3).alias("conf"), F.count(F.lit(1)).alias("n")
        )


SQL = {
    "v_sources": r"""
  SELECT source AS code, n % 11 AS trust_level, CASE WHEN n % 2 = 0 THEN 'telegram' ELSE 'html' END AS kind, n % 5 <> 0 AS enabled
  FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) AS n FROM documents)""",
    "v_news": """
  SELECT doc_id AS id, text AS text_plain, lang, source, n_chars, 1704067200 + doc_id * 420 AS pub, sha256(text) AS hash_content,
         CASE WHEN coalesce(f, '') = '' THEN '(untitled)' WHEN length(f) > 200 THEN f[1:197] || '...' ELSE f END AS title
  FROM (SELECT *, trim(split_part(text, chr(10), 1), ' ') AS f FROM documents)""",
    "v_events": """
  SELECT event_id AS id, ts, epoch_us(ts) AS us,
         CASE event_type WHEN 'error' THEN 'sanctions' WHEN 'click' THEN 'earnings_miss' WHEN 'view' THEN 'regulatory'
                         WHEN 'purchase' THEN 'm&a' WHEN 'signup' THEN 'rate_hike' ELSE 'other' END AS event_type,
         'T' || (user_id % 20) AS ticker, 'C' || user_id AS company, value, k,
         list_filter(['T' || (user_id % 20), CASE WHEN k % 3 = 0 THEN 'T' || ((user_id + 7) % 20) END, CASE WHEN k % 4 = 0 THEN 'T' || ((user_id + 11) % 20) END,
                      CASE WHEN k % 5 = 0 THEN 'T' || ((user_id + 13) % 20) END], lambda x: x IS NOT NULL) AS tickers,
         list_filter(['C' || user_id, CASE WHEN k % 2 = 0 THEN 'C' || (user_id + 1) END, CASE WHEN k % 3 = 0 THEN 'C' || (user_id + 2) END, CASE WHEN k % 6 = 0 THEN 'C' || (user_id + 3) END,
                      CASE WHEN k % 6 = 0 THEN 'C' || (user_id + 4) END, CASE WHEN k % 6 = 0 THEN 'C' || (user_id + 5) END, CASE WHEN k % 9 = 0 THEN 'C' || (user_id + 6) END], lambda x: x IS NOT NULL) AS companies,
         event_id % (SELECT count(*) FROM documents) AS news_id, event_type IN ('error', 'click', 'view', 'purchase', 'signup') AS is_anchor
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "v_sectors": "SELECT 'T' || secid AS ticker, sector FROM v_companies WHERE secid < 20",
    "v_impacts": """
  SELECT id AS event_id, tickers[p + 1] AS ticker, (k - 50) / (5000 + 2000 * p)::DOUBLE AS price_impact, value / 40 AS volume_impact
  FROM v_events, range(0, 2) r(p) WHERE id % 2 = 0 AND p < len(tickers)""",
    "v_importance": """
  SELECT id AS event_id, us AS calculated, event_type, least(value / 200, 1.0) AS importance_score FROM v_events
  UNION ALL SELECT id, us + 3600000000, event_type, least(value / 200, 1.0) * 0.9 FROM v_events WHERE id % 2 = 0""",
    "v_prices": """
  SELECT l_suppkey AS secid, CAST(l_shipdate AS DATE) AS day, round(avg(l_extendedprice / l_quantity) + 1e-9, 6) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY ALL""",
    "v_companies": """
  SELECT s_suppkey AS secid, s_name AS name, n_name AS sector, r_name AS country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_watches": """
  SELECT id AS event_id, 'rule_' || event_type AS rule_id, 'L' || (id % 3) AS watch_level,
         CASE WHEN id % 4 = 0 THEN 'notified' WHEN id % 7 = 0 THEN 'expired' ELSE 'triggered' END AS status, us AS triggered, least(value / 200, 1.0) AS importance
  FROM v_events WHERE value >= 60""",
    "v_outbox": """
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'sent' WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'pending' END AS status,
         CAST(o_orderkey % 5 AS INTEGER) AS retry_count, CAST(epoch(o_orderdate) AS BIGINT) AS created,
         CASE WHEN o_orderkey % 4 > 0 THEN CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey % 4) * 60 END AS next_retry
  FROM orders""",
    "v_edges": """
  SELECT a.l_suppkey AS src, b.l_suppkey AS dst, max(a.l_partkey % 60) / 100.0::DOUBLE + 0.3::DOUBLE AS conf, count(*) AS n
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_quantity >= 45 AND a.l_discount >= 0.09 AND a.l_suppkey <> b.l_suppkey GROUP BY a.l_suppkey, b.l_suppkey""",
}
NEEDS = {"v_sectors": ["v_companies"], "v_impacts": ["v_events"], "v_importance": ["v_events"], "v_watches": ["v_events"]}


def sql(query: str) -> str:
    """The query after the views that it names."""
    names = [v for v in SQL if v in query]
    todo = list(dict.fromkeys(n for v in names for n in [*NEEDS.get(v, []), v]))
    body = query.strip()
    if not todo:
        return body
    views = ",\n".join(f"{v} AS ({SQL[v]})" for v in todo)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
