import pytest
from pyspark.sql import functions as F

from tidewater.llm import urlbloom, urls

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
CASES = [
    # url, host, path, rule
    (None, "", "", None),
    ("", "", "", None),
    ("no scheme/net/", "", "", None),
    ("http://EXAMPLE.net/en/1", "example.net", "/en/1", "example.net/en/"),
    ("https://a.b.example.net/de/?q=1", "a.b.example.net", "/de/", "net/"),
    ("http://badexample.net/en/", "badexample.net", "/en/", "net/"),
    ("http://example.com/de", "example.com", "/de", None),
    ("http://m.example.com/de/x#y", "m.example.com", "/de/x", "example.com/de/"),
    ("x://y.org/fr/http://z.net/", "y.org", "/fr/http://z.net/", "org/fr/"),
    ("http://a.net?x=/", "a.net", "", None),
    ("http://net/", "net", "/", "net/"),
    ("http://É.org/fr/", "É.org", "/fr/", "org/fr/"),
    ("a\nb://h.org/fr/\nx?y", "h.org", "/fr/\nx", "org/fr/"),
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, c[0], "x", "y") for i, c in enumerate(CASES)] + [(0, None, "x", "y")], "page_id long, url string, host string, listed string")
    listed = spark.createDataFrame([], "canonical_url string")
    got = urlbloom.judge(pages, listed, RULES).collect()
    assert len(got) == len(CASES) + 1
    for r in got:
        _, host, path, rule = CASES[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (dict(RULES)[rule] if rule else "allow")


def test_canonical(spark):
    cases = {
        "https://www.A.com/x/?utm_source=f&id=3&ref=x#top": "a.com/x?id=3",
        "http://m.a.com/x//": "a.com/x",
        "http://a.com?reference=1&utm=2": "a.com?reference=1&utm=2",
        "http:///x": None,
        "none": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string").select("url", urls.canonical(F.col("url")).alias("c"))
    assert {r.url: r.c for r in df.collect()} == cases


@pytest.mark.parametrize("blocks", [1, 1 << 10])
def test_list_is_exact_whatever_the_filter(spark, monkeypatch, blocks):
    monkeypatch.setattr(urlbloom, "MAX_BLOCKS", blocks)
    listed = spark.createDataFrame([(f"h.com/{i}",) for i in range(0, 2000, 3)] * 2 + [(None,)], "canonical_url string")
    rows = spark.createDataFrame([(i, f"h.com/{i}") for i in range(2000)] + [(-1, None)] + [(3, "h.com/3")] * 5, "page_id long, k string")
    got = urlbloom.in_list(rows, F.col("k"), listed, F.col("canonical_url")).collect()
    assert len(got) == 2006
    assert all(r.listed == (r.page_id >= 0 and r.page_id % 3 == 0) for r in got)


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"))
    blocks = urlbloom.blocks_for(2000)
    bloom = urlbloom.build(keys, "k", blocks)
    assert bloom.count() <= blocks
    probe = spark.range(4000).select("id", F.concat(F.lit("k"), "id").alias("k"))
    block, masks = urlbloom._address(F.col("k"), blocks)
    hit = F.lit(True)
    for j, m in enumerate(masks):
        hit = hit & (F.col(f"w{j}").bitwiseAND(m) == m)
    passed = probe.join(bloom, block == F.col("block")).filter(hit)
    assert passed.filter("id < 2000").count() == 2000
    assert passed.filter("id >= 2000").count() < 100
