"""Queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import blobs, bpe, cascade, licences, posindex, ppm, revisit, shards, simhash, urlbloom, urls
from tidewater.session import spread

#: The rank file is a parameter of the operator; this is the one the query uses.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = revisit.records_of(_table(spark, sf_dir, "pages"))
    return revisit.resolve(records).select(
        "record_id", F.col("canon").alias("canonical_url"), "ts", "resolved_id", "status", revisit.header_lines(F.col("headers")).alias("headers")
    )


#: The canonical form of urls.canonical() in SQL.
CANONICAL_SQL = r"""
p AS (
  SELECT *, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         array_to_string(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), ''), '&'),
                                     lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[^=]*|ref)(?:=|$)')), '&') AS query
  FROM pages),
c AS (
  SELECT *, CASE WHEN regexp_replace(host, '^(?:www|m)\.', '') <> ''
                 THEN regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canon
  FROM p)
"""

OP1_SQL = (
    "WITH" + CANONICAL_SQL + r"""
, r AS (
  SELECT page_id, canon, 1704067200 + page_id * 60 AS ts, '"' || substr(md5(html), 1, 16) || '"' AS etag, length(html) AS size FROM c),
found AS (
  SELECT v.page_id, v.canon, v.ts + 7776000 AS ts, v.etag, max(struct_pack(ts := f.ts, page_id := f.page_id)) AS x
  FROM r v LEFT JOIN r f ON f.canon = v.canon AND f.ts < v.ts + 7776000
  GROUP BY ALL),
both_ AS (
  SELECT found.page_id, found.canon, found.ts, found.etag, r.page_id AS rid, r.etag AS r_etag, r.size FROM found LEFT JOIN r ON r.page_id = found.x.page_id)
SELECT page_id * 2 + 1 AS record_id, canon AS canonical_url, ts, rid * 2 AS resolved_id,
       CASE WHEN rid IS NULL THEN 'no_response' WHEN etag <> r_etag THEN 'etag_mismatch'
            WHEN etag IS NULL OR r_etag IS NULL THEN 'unvalidated' ELSE 'resolved' END AS status,
       CASE WHEN rid IS NOT NULL AND etag = r_etag
            THEN 'cache-control: max-age=3600' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
                 || 'date: ' || ts || chr(10) || 'etag: ' || r_etag || chr(10) || 'set-cookie: visit=1'
            ELSE 'cache-control: max-age=3600' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts || chr(10) || 'set-cookie: visit=2' END AS headers
FROM both_
"""
)


def op2_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(_table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked"
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"), licences.train())


def op4_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ordered = cascade.order(cascade.RULES, cascade.profile(docs))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return cascade.run(docs, ordered, names).select("doc_id", *names, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), "rejected_by", "n_tried")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^ 	-
]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
m AS MATERIALIZED (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ 	-
]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals,
         length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS n_letters
  FROM d),
tri AS (SELECT doc_id, i, w[i : i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, x FROM tri GROUP BY doc_id, x HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM tri JOIN twice USING (doc_id, x)) GROUP BY doc_id),
a AS MATERIALIZED (SELECT m.*, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN covered USING (doc_id)),
f AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT < round(least(1.0::DOUBLE, 1000 / greatest((SELECT count(*) FROM a), 1)::DOUBLE) * 4294967296) AS drawn,
         [CASE WHEN n_words < 50 THEN 'few_words' END, CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 'repeated_words' END,
          CASE WHEN 10 * n_symbols > n_words THEN 'symbols' END, CASE WHEN 2 * n_dup_lines > n_lines THEN 'repeated_lines' END,
          CASE WHEN word_chars < 2 * n_words THEN 'short_words' END, CASE WHEN word_chars > 15 * n_words THEN 'long_words' END,
          CASE WHEN 2 * n_capitals > n_letters THEN 'capitals' END, CASE WHEN 2 * n_bangs > n_words THEN 'bangs' END] AS by_
  FROM a JOIN (SELECT doc_id AS d_id, strlen(t) AS n_bytes FROM d) ON d_id = doc_id),
rules(name, per_byte, per_word, per_line) AS (
  VALUES ('few_words', 0, 150, 0), ('repeated_words', 0, 770, 0), ('symbols', 4, 150, 0), ('repeated_lines', 0, 0, 1750),
         ('short_words', 7, 150, 0), ('long_words', 7, 150, 0), ('capitals', 11, 0, 0), ('bangs', 2, 150, 0)),
read AS (SELECT coalesce(sum(n_bytes), 0) AS b, coalesce(sum(n_words), 0) AS w, coalesce(sum(n_lines), 0) AS l FROM f WHERE drawn),
places AS (
  SELECT name, row_number() OVER (ORDER BY rejected / greatest(CAST(per_byte * b + per_word * w + per_line * l AS BIGINT), 1)::DOUBLE DESC, name) AS place
  FROM (SELECT rules.*, read.*, (SELECT count(*) FROM f WHERE drawn AND list_contains(by_, name)) AS rejected FROM rules, read)),
first AS (SELECT doc_id, min_by(name, place) AS rejected_by, min(place) AS n_tried FROM (SELECT doc_id, unnest(by_) AS name FROM f) JOIN places USING (name) GROUP BY doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       rejected_by IS NULL AS kept, rejected_by, CAST(coalesce(n_tried, 8) AS BIGINT) AS n_tried
FROM f LEFT JOIN first USING (doc_id)
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=2, seed=42)
    return near.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries: the English documents, then the whole table, of which only blobs that
    the first didn't bring are scanned."""
    docs = _table(spark, sf_dir, "documents")
    ledger = blobs.Ledger(spark)
    ledger.update(docs.filter("lang = 'en'"))
    ledger.update(docs)
    kinds = [r.kind for r in blobs.BASE_RULES]
    spans = F.col("spans")
    return ledger.on_paths(docs, ["doc_id"]).select(
        "doc_id",
        *[F.size(blobs.of_kinds(spans, [k])).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(blobs.listed(blobs.of_kinds(spans, kinds)).cast("binary"), 256).alias("base_sha256"),
        blobs.listed(spans).alias("spans"),
    )


def _spans_sql(kind: str, rank: int, pattern: str, keep: str = "true") -> str:
    """Matches m of one kind with their places: what lies between them gives the starts."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, x AS start, x + length(m) AS stop FROM (
    SELECT doc_id, m[i] AS m, coalesce(list_sum(list_transform(p[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS x
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p, unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i FROM d))
  WHERE {keep.format(p=pattern)}"""


_ASSIGN_SQL = (
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
OP6_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join(
        [
            _spans_sql("assign", 0, _ASSIGN_SQL, "length(regexp_extract(m, '{p}', 1)) >= 12"),
            _spans_sql("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 18"),
            _spans_sql("hex", 2, "[0-9a-f]{{16,}}".format()),
            _spans_sql("pem", 3, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?"),
            _spans_sql("jwt", 4, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
            _spans_sql("forge", 5, "gh[pousr]_[A-Za-z0-9]{36,}"),
        ]
    )
    + """)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""
)

#: The rules of the URL query.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op7_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of all pages that some campaign link (utm_...) led to."""
    pages = _table(spark, sf_dir, "pages")
    listed = pages.filter(F.col("url").rlike(r"[?&]utm_")).select(urls.canonical(F.col("url")).alias("canonical_url"))
    return urlbloom.judge(pages, listed, URL_RULES)


OP7_SQL = (
    "WITH" + CANONICAL_SQL + r"""
, listed AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(url, '[?&]utm_')),
ruled AS (
  SELECT page_id, host, path, canon,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
            ELSE CASE WHEN canon IN (SELECT canon FROM listed WHERE canon IS NOT NULL) THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled
"""
)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = public_tokenizers.path(RANKS)
    return bpe.digests(bpe.encode(docs, path, public_tokenizers.PATTERN, with_decoded=True, with_text=True))


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = posindex.build(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return posindex.contamination(index, window=10).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
        F.size("near_items").cast("long").alias("n_near_items"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[k : k + size - 1], ' ') AS gram
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM item)),
sizes AS (SELECT DISTINCT size FROM item),
grams AS (
  SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, k, g.size FROM grams g JOIN windows USING (size, gram)),
hit_words AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS pos FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
places AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d),
df AS (SELECT term, count(*) AS df FROM places GROUP BY term),
ranks AS (
  SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY df, term) AS rank
  FROM (SELECT DISTINCT item_id, unnest(w) AS term FROM item) JOIN df USING (term)),
lists AS (SELECT doc_id, item_id, rank, pos, wanted FROM places JOIN ranks USING (term) JOIN (SELECT item_id, least(3, max(rank)) AS wanted FROM ranks GROUP BY item_id) USING (item_id) WHERE rank <= 3),
met AS (
  SELECT a.doc_id, a.item_id, a.pos FROM lists a JOIN lists b ON b.doc_id = a.doc_id AND b.item_id = a.item_id AND abs(b.pos - a.pos) <= 20
  WHERE a.rank = 1 GROUP BY a.doc_id, a.item_id, a.pos, a.wanted HAVING count(DISTINCT b.rank) = a.wanted),
near AS (SELECT doc_id, count(*) AS n_near, count(DISTINCT item_id) AS n_near_items FROM met GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ppm.learn(docs.filter(~ppm.held_out("doc_id")), calibrate=False)
    return ppm.predict(docs, model).select("doc_id", ppm.held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_revisits": op1_revisits,
    "op2_label_propagation": op2_label_propagation,
    "op3_licences": op3_licences,
    "op4_rule_cascade": op4_rule_cascade,
    "op5_simhash": op5_simhash,
    "op6_blob_ledger": op6_blob_ledger,
    "op7_url_bloom": op7_url_bloom,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_positional_index": op9_positional_index,
    "op10_language_id": op10_language_id,
}

ORACLES: dict[str, str] = {
    "op1_revisits": OP1_SQL,
    "op4_rule_cascade": OP4_SQL,
    "op6_blob_ledger": OP6_SQL,
    "op7_url_bloom": OP7_SQL,
    "op9_positional_index": OP9_SQL,
}
