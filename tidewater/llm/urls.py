"""Parts and canonical forms of URLs, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^[^?#]*\?([^#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without closing slashes, and the query without
    campaign parameters; no scheme and no fragment. Null without a host."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    params = F.filter(F.split(F.regexp_extract(url, QUERY, 1), "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_[^=]*|ref)(?:=|$)"))
    query = F.array_join(params, "&")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))
