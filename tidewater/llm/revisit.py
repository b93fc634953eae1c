"""WARC not-modified revisits resolved to the full responses they stand for.

A revisit is joined as of its time to the latest strictly earlier full response of
its canonical URL; its validators are checked against that response, and the
headers that a not-modified answer may update are merged into the response's.

The as-of join runs over distinct (URL, time) points. They are cut into time
slices at approximate quantiles: within (URL, slice) a window gives the last
response; the last response of each earlier slice, one row a slice, is carried
over. So a URL with a third of all captures is dealt over all slices, and captures
at one moment are one point.

Header names are lower-cased on entry, as they don't depend on case; the values of
names that then are equal are joined by ", " in the order of the names as written.

Defined results: a null URL, or no earlier response, gives status no_response; a
response without id is none; of responses at one moment the largest record id
counts, and of rows that repeat it the one with the largest entity tag, date and
headers; a null validator on either side isn't compared, and none that can be
compared gives status unvalidated; repeated revisits are resolved one by one. Other
columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import urls
from tidewater.llm.common import stored

#: Headers that describe the stored body, connection or client; a
#: not-modified answer doesn't update them.
KEPT_HEADERS = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag",
    "keep-alive", "proxy-authenticate", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade",
]
#: Time slices that one URL's captures are dealt over.
SLICES = 64


def records_of(pages: DataFrame) -> DataFrame:
    """Capture records of a table of pages (page_id, url, html), which has no times or headers.

    Every page is a full response at minute page_id and is asked for again 90 days
    later, when the server answers not modified for the page's own entity tag.
    """
    base = pages.select(
        "page_id",
        "url",
        urls.canonical(F.col("url")).alias("canon"),
        (F.lit(1704067200) + F.col("page_id") * 60).alias("ts"),
        F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 16), F.lit('"')).alias("etag"),
        F.length("html").cast("string").alias("size"),
    )
    pair = F.array(
        F.struct(F.lit("response").alias("kind"), F.lit(0).alias("odd"), F.lit(0).alias("later")),
        F.struct(F.lit("revisit").alias("kind"), F.lit(1).alias("odd"), F.lit(90 * 86400).alias("later")),
    )
    rows = base.withColumn("k", F.explode(pair)).withColumn("when", F.col("ts") + F.col("k.later"))
    first = F.create_map(
        F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size"), F.lit("etag"), F.col("etag"),
        F.lit("cache-control"), F.lit("max-age=60"), F.lit("set-cookie"), F.lit("visit=1"),
    )
    again = F.create_map(
        F.lit("cache-control"), F.lit("max-age=3600"), F.lit("date"), F.col("when").cast("string"), F.lit("content-length"), F.lit("0"), F.lit("set-cookie"), F.lit("visit=2"),
    )
    return rows.select(
        (F.col("page_id") * 2 + F.col("k.odd")).alias("record_id"), "page_id", "url", "canon", F.col("when").alias("ts"),
        F.col("k.kind").alias("kind"), "etag", F.lit(None).cast("string").alias("last_modified"),
        F.when(F.col("k.kind") == "response", first).otherwise(again).alias("headers"),
    )


def latest_earlier(points: DataFrame, slices: int = SLICES) -> DataFrame:
    """(canon, ts, found) for points (canon, ts, rid), each (canon, ts) once: the rid, of
    any type, of the latest strictly earlier point that has one."""
    shares = [i / slices for i in range(1, slices)]
    cuts = points.agg(F.percentile_approx("ts", shares, 1000).alias("c")).first().c or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>")
    cut = points.withColumn("slice", F.size(F.filter(cuts, lambda c: c <= F.col("ts"))))
    inside = Window.partitionBy("canon", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    within = cut.withColumn("own", F.last("rid", ignorenulls=True).over(inside))
    ends = cut.groupBy("canon", "slice").agg(F.max_by("rid", F.when(F.col("rid").isNotNull(), F.col("ts"))).alias("end"))
    before = Window.partitionBy("canon").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("canon", "slice", F.last("end", ignorenulls=True).over(before).alias("carried"))
    return within.join(carried, ["canon", "slice"]).select("canon", "ts", F.coalesce("own", "carried").alias("found"))


def _opaque(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(tag, "^W/", "")


def lower_names(headers: Column) -> Column:
    """Headers by lower-cased name."""
    names = F.transform(F.map_keys(headers), F.lower)
    entries = F.array_sort(F.map_entries(headers))

    def value(n: Column) -> Column:
        own = F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"])
        return F.when(F.exists(own, lambda v: v.isNotNull()), F.array_join(own, ", "))

    joined = F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n, value(n))))
    return F.when(F.size(F.array_distinct(names)) < F.size(names), joined).otherwise(F.transform_keys(headers, lambda k, v: F.lower(k)))


def merged(response: Column, revisit: Column) -> Column:
    """The response's headers, updated by those of the revisit that may be."""
    fresh = F.map_filter(revisit, lambda k, v: ~k.isin(KEPT_HEADERS))
    old = F.map_filter(response, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(fresh), k), F.lit(False)))
    return F.coalesce(F.map_concat(old, fresh), response)


def resolve(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row for each revisit of records (record_id, canon, ts, kind, etag, last_modified, headers):
    record_id, canon, ts, resolved_id, status, headers."""
    records = records.select("record_id", "canon", "ts", "kind", "etag", "last_modified", lower_names(F.col("headers")).alias("headers"))
    known = records.filter(F.col("canon").isNotNull() & F.col("ts").isNotNull())
    full = known.filter("kind = 'response' and record_id is not null")
    at = F.when((F.col("kind") == "response") & F.col("record_id").isNotNull(), F.struct("ts", "record_id"))
    points = stored(known.groupBy("canon", "ts").agg(F.max(at).alias("rid")), "points")
    found = latest_earlier(points, slices).filter("found is not null").select("canon", "ts", "found.*", F.lit(True).alias("any")).toDF("canon", "ts", "r_ts", "r_id", "any")
    placed = records.filter("kind = 'revisit'").drop("kind").join(found, ["canon", "ts"], "left")
    # of repeated rows one is chosen by its values
    values = F.max(F.struct(F.col("etag").alias("e"), F.col("last_modified").alias("m"), F.array_sort(F.map_entries("headers")).alias("h"))).alias("x")
    responses = full.groupBy(F.col("canon").alias("r_canon"), F.col("ts").alias("at"), F.col("record_id").alias("rid")).agg(values).select(
        "r_canon", "at", "rid", F.col("x.e").alias("r_etag"), F.col("x.m").alias("r_modified"), F.map_from_entries("x.h").alias("r_headers")
    )
    both = placed.join(responses, (F.col("canon") == F.col("r_canon")) & (F.col("r_ts") == F.col("at")) & (F.col("r_id") == F.col("rid")), "left")
    status = (
        F.when(F.col("r_id").isNull(), "no_response")
        .when(_opaque(F.col("etag")) != _opaque(F.col("r_etag")), "etag_mismatch")
        .when(F.col("etag").isNotNull() & F.col("r_etag").isNotNull(), "resolved")
        .when(F.col("last_modified") != F.col("r_modified"), "date_mismatch")
        .when(F.col("last_modified").isNotNull() & F.col("r_modified").isNotNull(), "resolved")
        .otherwise("unvalidated")
    )
    both = both.withColumn("status", status)
    headers = F.when(F.col("status") == "resolved", merged(F.col("r_headers"), F.col("headers"))).otherwise(F.col("headers"))
    return both.select("record_id", "canon", "ts", F.col("r_id").alias("resolved_id"), "status", headers.alias("headers"))


def header_lines(headers: Column) -> Column:
    """name: value lines by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
