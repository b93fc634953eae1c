import random

from pyspark.sql import functions as F

from tidewater.llm import revisit

SCHEMA = "record_id long, canon string, ts long, kind string, etag string, last_modified string, headers map<string,string>, found string, slice int"


def small(headers):
    out = {}
    for k, v in sorted(headers.items()):
        out[k.lower()] = out[k.lower()] + ", " + v if k.lower() in out else v
    return out


def brute(rows):
    out = []
    for rid, canon, ts, kind, etag, modified, headers in rows:
        if kind != "revisit":
            continue
        older = [r for r in rows if r[3] == "response" and canon is not None and r[1] == canon and ts is not None and r[2] is not None and r[2] < ts]
        order = lambda v: (v is not None, v or "")
        best = max(older, key=lambda r: (r[2], r[0], order(r[4]), order(r[5]), r[6] is not None, sorted(small(r[6] or {}).items())), default=None)
        weak = lambda t: t[2:] if t.startswith("W/") else t
        if best is None:
            status = "no_response"
        elif etag is not None and best[4] is not None:
            status = "resolved" if weak(etag) == weak(best[4]) else "etag_mismatch"
        elif modified is not None and best[5] is not None:
            status = "resolved" if modified == best[5] else "date_mismatch"
        else:
            status = "unvalidated"
        headers = headers and small(headers)
        if status == "resolved" and best[6] is not None:
            headers = {**small(best[6]), **{k: v for k, v in (headers or {}).items() if k not in revisit.KEPT_HEADERS}}
        elif status == "resolved":
            headers = best[6]
        out.append((rid, canon, ts, best and best[0], status, headers))
    return out


def key(rows):
    return sorted(str((a, b, c, d, e, sorted(f.items()) if f is not None else None)) for a, b, c, d, e, f in rows)


def test_matches_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        canon = rng.choice(["hot", "hot", "hot", None, *(f"u{k}" for k in range(20))])
        kind = rng.choice(["response", "revisit"])
        etag = rng.choice([None, '"a"', 'W/"a"', '"b"'])
        rows.append((i, canon, rng.choice([None, *range(60)]), kind, etag, rng.choice([None, "mon", "tue"]), rng.choice([None, {}, {"date": str(i), "etag": "x", "content-type": kind}, {"Date": str(i), "date": "d", "Content-Length": kind, "X-A": None}])))
    rows += [r for r in rows if r[3] == "revisit"][:5]
    again = [r for r in rows if r[3] == "response"][:60]
    rows += [(*r[:4], rng.choice([None, '"a"', '"c"']), None, rng.choice([None, {"a": str(i)}])) for i, r in enumerate(again)]  # repeated ids
    rows += [(r[0], r[1], (r[2] or 0) + 7, *r[3:]) for r in again[:30]]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)
    for slices in (1, 4, 64):
        got = revisit.resolve(df, slices).collect()
        assert key([tuple(r) for r in got]) == key(brute(rows))


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://www.a.com/x?utm_source=f", "<p>"), (2, "https://a.com/x/", "<p>2"), (3, None, "x"), (4, "http://b.com/", None)], "page_id long, url string, html string"
    )
    out = {r.record_id: r for r in revisit.resolve(revisit.records_of(pages)).collect()}
    assert {k: (r.resolved_id, r.status) for k, r in out.items()} == {3: (4, "etag_mismatch"), 5: (4, "resolved"), 7: (None, "no_response"), 9: (8, "unvalidated")}
    assert out[5].headers["set-cookie"] == "visit=1" and out[5].headers["cache-control"] == "max-age=3600"
    assert revisit.resolve(revisit.records_of(pages.limit(0))).collect() == []
    assert out[5].headers["content-length"] == "4" and F is not None


def test_header_names_have_no_case(spark):
    rows = [
        (1, "u", 1, "response", '"a"', None, {"Content-Length": "500", "Cache-Control": "max-age=1", "X": "1"}, None, None),
        (2, "u", 2, "revisit", '"a"', None, {"content-length": "0", "cache-control": "max-age=2"}, None, None),
    ]
    (r,) = revisit.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (r.resolved_id, r.headers) == (1, {"content-length": "500", "cache-control": "max-age=2", "x": "1"})
