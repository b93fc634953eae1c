"""Operators on small tables."""

import datetime
import itertools
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tidewater import queries
from tidewater.operators import analytics as A
from tidewater.operators import ceg, graph, ingest, market, nlp, search, watch
from tidewater.plans.joins import asof_join, interval_join, near_sums, near_window, ngram_join
from tidewater.sources import files

T0 = datetime.datetime(2024, 1, 1)


def ts(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def test_interval_join_equals_nested_loops(spark):
    rng = random.Random(3)
    a = [(i, rng.choice("xy"), ts(rng.uniform(-5000, 20000))) for i in range(80)]
    b = [(i, rng.choice("xy"), ts(rng.uniform(-5000, 20000))) for i in range(90)]
    left, right = spark.createDataFrame(a, "i int, k string, t timestamp"), spark.createDataFrame(b, "j int, k string, u timestamp")
    for lo, hi in ((0, 3600), (-600, 900), (3600, 7200), (0, 0)):
        got = sorted((r.i, r.j) for r in interval_join(left, right, "t", "u", lo, hi, ["k"]).collect())
        assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and lo <= (y[2] - x[2]).total_seconds() <= hi)


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 10), (4, "a", 11)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 6, 1.0), ("a", 10, 2.0), ("a", 10, 3.0), ("a", 20, 4.0)], "k string, u int, v double")
    assert {r.id: r.v for r in asof_join(left, right, ["k"], "t", "u", ["v"]).collect()} == {1: 3.0, 2: None, 3: None, 4: 3.0}
    assert {r.id: r.v for r in asof_join(left, right, ["k"], "t", "u", ["v"], forward=True).collect()} == {1: 3.0, 2: 1.0, 3: None, 4: 4.0}


def test_asof_join_with_a_tolerance(spark):
    rng = random.Random(12)
    a = [(i, rng.choice("xy"), ts(rng.randint(0, 5000))) for i in range(60)]
    b = [(rng.choice("xy"), ts(rng.randint(0, 5000)), i) for i in range(25)]
    left, right = spark.createDataFrame(a, "id int, k string, t timestamp"), spark.createDataFrame(b, "k string, u timestamp, v int")
    for forward in (False, True):
        got = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "u", ["v"], tolerance=300, forward=forward).collect()}
        for i, k, t in a:
            gap = lambda y, t=t: (y[1] - t).total_seconds() * (1 if forward else -1)
            near = [y for y in b if y[0] == k and 0 <= gap(y) <= 300]
            best = min(near, key=lambda y: (gap(y), -y[2]), default=None)
            assert got[i] == (best[2] if best else None)


def test_near_window_equals_counting(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("xy"), rng.randint(0, 500)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, k string, us long")
    for back, ahead in ((50, 0), (50, -1), (30, 70)):
        got = {r.id: r.n for r in near_window(df, ["k"], "us", back, ahead, {"n": lambda w: F.count(F.lit(1)).over(w)}).collect()}
        assert got == {i: sum(1 for _, k2, u2 in rows if k2 == k and u - back <= u2 <= u + ahead) for i, k, u in rows}


def test_ngram_join(spark):
    texts = spark.createDataFrame([(1, "a big red dog"), (2, "red dog red dog")], "id int, t string")
    d = spark.createDataFrame([("red dog", "RD"), ("big", "B"), ("cat", "C")], "phrase string, code string")
    got = ngram_join(texts, "id", F.split("t", " "), d, "phrase", 2).collect()
    assert {(r.id, r.code, r.position) for r in got} == {(1, "RD", 3), (1, "B", 2), (2, "RD", 1)}


def test_histogram_of_equal_values(spark):
    h = A.histogram(spark.createDataFrame([(2.0,)] * 4, "x double"), "x", 5).orderBy("bin").collect()
    assert [r.n for r in h] == [4, 0, 0, 0, 0]


def test_event_study(spark):
    closes = [100.0, 101.0, 102.0] * 4 + [110.0, 111.0]
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=i) for i in range(len(closes))]
    prices = spark.createDataFrame([(1, d, c, 1000.0) for d, c in zip(days, closes)], "secid int, day date, close double, volume double")
    event = spark.createDataFrame([(7, 1, days[12])], "id int, secid int, day date")
    r = market.event_study(event, prices, estimation=10, least=10).first()
    assert r.significant and r.ar == pytest.approx(0.07735333, abs=1e-6) and r.sigma == pytest.approx(0.01427468, abs=1e-6)
    assert r.car == pytest.approx(0.09418914, abs=1e-6)


def test_causal_pairs_respect_lags(spark):
    rows = [(1, ts(0), "sanctions", "T"), (2, ts(86400), "other", "T"), (3, ts(86401), "other", "T"), (4, ts(0), "other", "T"), (5, ts(90), "rate_hike", "T"), (6, ts(100), "other", "U")]
    e = spark.createDataFrame(rows, "id int, ts timestamp, event_type string, ticker string")
    assert {(r.cause_id, r.effect_id, r.kind) for r in ceg.causal_pairs(e, ["ticker"]).collect()} == {(1, 2, "RETRO"), (1, 5, "RETRO")}
    full = ceg.causal_pairs(e.withColumn("text_conf", F.lit(0.8)), ["ticker"]).collect()
    pairs = {(r.cause_id, r.effect_id): r for r in full}
    assert len(full) == len(pairs) and pairs[5, 2].kind == "CONFIRMED"
    # outside the lag the prior counts half: 0.4 x 0.375 + 0.3 x 0.8, a day and a second after the sanctions
    assert pairs[1, 3].kind == "HYPOTHESIS" and pairs[1, 3].conf_total == pytest.approx(0.39)
    # before the lag of a rate hike has begun
    assert (4, 2) not in pairs and ceg.causal_pairs(e.withColumn("text_conf", F.lit(1.0)), ["ticker"]).filter("cause_id = 4").count() > 0
    weak = ceg.causal_pairs(e.withColumns({"text_conf": F.lit(0.4), "market_conf": F.lit(1.0)}), ["ticker"]).collect()
    assert {(r.cause_id, r.effect_id): r.conf_total for r in weak}[1, 2] == pytest.approx(0.72) and not any(r.effect_id == 3 and r.cause_id == 1 for r in weak)


def test_causal_pairs_come_from_blocks(spark, sf_dir, monkeypatch):
    """All types, with text and market confidence, nulls, equal times and repeated ids, in blocks of five; a loop."""
    monkeypatch.setattr(ceg, "BLOCK", 5)
    rng = random.Random(3)
    kinds = [*{p[0] for p in ceg.dims.PRIORS}, "other", None]
    rows = [(rng.randrange(80), ts(rng.randrange(0, 40 * 86400, 1800)) if rng.random() < 0.95 else None, rng.choice(kinds), rng.choice(["A", "B", None]), rng.choice([0.0, 0.0, 0.6, 0.9, 1.0, None]), rng.choice([0.0, 0.7])) for _ in range(160)]
    e = spark.createDataFrame(rows, "id long, ts timestamp, event_type string, ticker string, text_conf double, market_conf double")
    priors = {p[0]: p for p in ceg.first_priors()}
    want = []
    for c in rows:
        for f in rows:
            if c[1] and f[1] and c[3] and c[3] == f[3] and datetime.timedelta(0) < f[1] - c[1] <= datetime.timedelta(days=30):
                _, expected, sign, lag, prior = priors.get(c[2], (None, None, "±", "0-7d", 0.0))
                lo, hi = ceg.dims.LAGS.get(lag, (0, 1e9))
                conf = prior * (1.0 if lo <= (f[1] - c[1]).total_seconds() <= hi else 0.5)
                text = f[4] or 0.0
                if 0.4 * conf + 0.3 * text >= 0.3:
                    kind = "CONFIRMED" if conf >= 0.6 and text >= 0.6 else "RETRO" if conf >= 0.5 else "HYPOTHESIS"
                    want.append((c[0], f[0], c[1], f[1], str(c[2]), str(f[2]), sign, str(expected), lag, conf, round(0.4 * conf + 0.3 * text + 0.3 * f[5], 6), kind))
    got = ceg.causal_pairs(e, ["ticker"], digits=6).collect()
    have = [(r.cause_id, r.effect_id, r.cause_ts, r.effect_ts, str(r.cause_type), str(r.effect_type), r.sign, str(r.expected), r.lag, r.conf_prior, r.conf_total, r.kind) for r in got]
    assert sorted(have) == sorted(want) and len(want) > 300
    # what a pair has is worked out for its effect: nothing is rounded or judged after the join
    plan = queries.QUERIES["causal_pairs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan.split("Join Inner")[0] and "CASE" not in plan.split("Join Inner")[0]


def test_causal_pairs_take_little_space(spark, tmp_path):
    """Effects come again and again in one order, confidences in runs."""
    e = spark.range(4096).select("id", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 20).alias("ts"), F.lit("sanctions").alias("event_type"), F.lit("T").alias("ticker"), F.element_at(F.array(F.lit(0.0), F.lit(0.7), F.lit(0.9)), (F.xxhash64("id") % 2 + 2).cast("int")).alias("text_conf"))
    ceg.causal_pairs(e, ["ticker"], digits=6).select("cause_id", "effect_id", "conf_total", "kind").write.parquet(str(tmp_path / "out"))
    n = 4096 * 4095 // 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == n
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size < 0.25 * n, size / n


def test_evidence_matches_a_loop(spark):
    rng = random.Random(5)
    kinds = ["sanctions", "market_drop", "volatility_spike", "trade_restrictions", "other"]
    rows = [(i, ts(rng.randrange(0, 4 * 86400, 1800)), rng.choice(kinds), rng.choice("AB"), rng.sample("xyz", rng.randrange(3)), rng.sample("uvw", rng.randrange(3)), rng.random()) for i in rng.sample(range(1000), 90)]
    e = spark.createDataFrame(rows, "id long, ts timestamp, event_type string, ticker string, entities array<string>, words array<string>, weight double")
    pairs = ceg.causal_pairs(e, ["ticker"])
    of = {r[0]: r for r in rows}
    links = ceg.dims.SEMANTIC_LINKS

    def score(c, x, f):
        linked = lambda a, b: b[2] in links.get(a[2], [])
        semantic = 0.6 * linked(c, x) + 0.6 * linked(f, x) + 0.4 * (linked(c, x) or linked(x, f))
        share = lambda a: len(set(x[5]) & set(a[5])) / len(a[5]) * 0.5 if a[5] else 0
        semantic = min(semantic + 0.3 * min(share(c) + share(f), 1), 1)
        most = max(len(c[4]), len(f[4]))
        entity = min((len(set(x[4]) & set(c[4])) + len(set(x[4]) & set(f[4]))) / most, 1) if most and x[4] else 0
        return 0.3 * (c[1] < x[1] < f[1]) + 0.3 * semantic + 0.25 * entity + 0.1 * 0.5 + 0.05 * x[6]

    want = {}
    for p in pairs.collect():
        c, f = of[p.cause_id], of[p.effect_id]
        near = [x for x in rows if x[3] == c[3] and c[1] - datetime.timedelta(hours=2) <= x[1] <= f[1] + datetime.timedelta(hours=2) and x[0] not in (c[0], f[0])]
        best = sorted((-round(score(c, x, f), 9), x[0]) for x in near if score(c, x, f) > 0.3)[:5]
        want |= {(c[0], f[0], i): (rank, -s) for rank, (s, i) in enumerate(best, 1)}
    for salts in (1, 3):
        got = ceg.evidence(pairs, e, ["ticker"], 86400, salts=salts).collect()
        assert {(r.cause_id, r.effect_id, r.evidence_id): (r.rank, round(r.score, 9)) for r in got} == want and len(got) == len(want) > 50
    assert ceg.evidence(pairs.limit(0), e, ["ticker"], 86400).collect() == []


def test_retroactive_matches_a_loop(spark):
    rng = random.Random(6)
    rows = [(i, ts(rng.randrange(0, 40 * 86400, 3600)), rng.choice(["A", "A", "B", None])) for i in range(300)]
    e = spark.createDataFrame(rows, "id long, ts timestamp, ticker string")
    want = set()
    for c in rows:
        after = sorted((x[1], x[0]) for x in rows if c[2] and x[2] == c[2] and datetime.timedelta(hours=1) < x[1] - c[1] <= datetime.timedelta(days=30))
        want |= {(c[0], i, k) for k, (_, i) in enumerate(after[:7], 1)}
    got = ceg.retroactive(e, e, ["ticker"], cap=7).collect()
    assert {(r.cause_id, r.effect_id, r["rank"]) for r in got} == want and len(got) == len(want)


def test_paths(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (3, 4, 0.9), (1, 3, 0.4)], "src long, dst long, conf double")
    got = {tuple(r.nodes): round(r.confidence, 6) for r in graph.paths(e, spark.createDataFrame([(1,)], "node long"), 3).collect()}
    assert got == {(1, 2): 0.5, (1, 3): 0.4, (1, 3, 4): 0.36, (1, 2, 3): 0.25, (1, 2, 3, 4): 0.225}
    assert {(r.parent, r.node, r.depth) for r in graph.chains(e, 1, 3).collect()} == {(1, 2, 1), (1, 3, 1), (3, 4, 2)}


def test_spread_takes_the_strongest_path(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.5), (1, 3, 0.2)], "src long, dst long, rho double")
    start = spark.createDataFrame([(1, 0.8)], "node long, base double")
    got = {r.target: round(r.weight, 6) for r in graph.spread(e, start, spark.createDataFrame([(2,)], "node long")).collect()}
    assert got == {3: 0.18}


def brute_dbscan(points, pairs, least):
    near = {p: {q for q in points if (p, q) in pairs or (q, p) in pairs} for p in points}
    cores = [p for p in points if len(near[p]) + 1 >= least]
    label = {c: c for c in cores}
    for _ in points:
        for a, b in itertools.product(cores, cores):
            if b in near[a]:
                label[a] = label[b] = min(label[a], label[b])
    out = dict(label)
    for p in points:
        if p not in out and any(q in label for q in near[p]):
            out[p] = min(label[q] for q in near[p] if q in label)
    return out


def test_clusters_and_density(spark):
    rng = random.Random(5)
    pairs = {(a, b) for a, b in itertools.combinations(range(40), 2) if rng.random() < 0.05}
    df = spark.createDataFrame(sorted(pairs), "src long, dst long")
    for least in (2, 3, 4):
        got = {r.node: r.cluster for r in graph.dense_points(df, least).collect()}
        assert got == {p: c for p, c in brute_dbscan(range(40), pairs, least).items() if any(p in x for x in pairs)}


def test_merge_and_upserts(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "node long, name string")
    edges = spark.createDataFrame([(2, 3), (1, 3), (1, 2)], "src long, dst long")
    kept, moved = graph.merge_nodes(nodes, edges, "name")
    assert {r.node for r in kept.collect()} == {1, 3} and [tuple(r) for r in moved.collect()] == [(1, 3)]
    old = spark.createDataFrame([(1, 10, "x"), (2, 10, "y")], "id long, at long, v string")
    new = spark.createDataFrame([(2, 11, "z"), (3, 11, "w")], "id long, at long, v string")
    once = ingest.upsert(old, new, ["id"], "at")
    assert {(r.id, r.v, r.is_updated) for r in once.collect()} == {(1, "x", False), (2, "z", True), (3, "w", False)}
    again = ingest.upsert(once.drop("is_updated"), new, ["id"], "at")
    assert {(r.id, r.v) for r in again.collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert {(r.id, r.v) for r in graph.upsert_nodes(old, new, "id", "at").collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert {(r.id, r.v) for r in ingest.patch(old, spark.createDataFrame([(1, "q")], "id long, v string"), "id", "v").collect()} == {(1, "q"), (2, "y")}


def test_outbox(spark):
    box = spark.createDataFrame([(1, "pending", 0, 5, None), (2, "failed", 1, 4, 50), (3, "failed", 3, 3, None), (4, "failed", 1, 2, 500), (5, "sent", 0, 1, None)], "id int, status string, retry_count int, created long, next_retry long")
    assert [r.id for r in A.eligible(box, 100).collect()] == [2, 1]
    done = spark.createDataFrame([(1, True), (2, False)], "id int, ok boolean")
    got = {r.id: (r.status, r.retry_count, r.next_retry) for r in ingest.after_attempt(box, done, 100).collect()}
    assert got[1] == ("sent", 0, None) and got[2] == ("failed", 2, 220) and got[4] == ("failed", 1, 500)
    assert {r.id for r in ingest.cleanup(box, 8 * 86400).collect()} == {1, 2, 3, 4}
    m = ingest.messages(box, "news.created", "id", ["id", "status"], F.col("created")).filter("aggregate_id = '1'").first()
    assert m.payload_json == '{"id":1,"status":"pending"}'


def test_incoming_and_images(spark):
    rows = [(1, "a", "h1", 1, False), (2, "b", "h1", 2, False), (3, "c", "h2", 3, True), (4, "d", "h3", 4, False), (5, "k", "h5", 5, False)]
    known = spark.createDataFrame([("k", "h9"), ("z", "h3")], "external_id string, hash_content string")
    df = spark.createDataFrame(rows, "id int, external_id string, hash_content string, pub long, is_ad boolean")
    got = {r.id: r.outcome for r in ingest.classify_incoming(df, known, ["external_id"]).collect()}
    assert got == {1: "saved", 2: "duplicate", 3: "ad", 4: "duplicate", 5: "duplicate"}
    raw = spark.createDataFrame([(b"x", "image/png"), (b"x", "image/png"), (b"y", "text/html"), (b"z" * 30, "image/png")], "bytes binary, mime_type string")
    assert ingest.images(raw, largest=20).count() == 1
    plan = spark.range(1).select(ingest.crawl_plan(F.array(F.lit("d1"), F.lit("d2")), ["a", "b"], 2, "u/{day}/{category}?p={page}").alias("u")).first().u
    assert len(plan) == 8 and "u/d2/b?p=2" in plan


def test_watches_and_predictions(spark):
    e = spark.createDataFrame([(1, 0, "sanctions", 0.9, 5, ["c"], ["banks"]), (2, 0, "sanctions", 0.9, 1, ["c"], ["banks"]), (3, 0, "default", 0.95, 1, [], [])], "id int, us long, event_type string, importance double, n24 long, companies array<string>, sectors array<string>")
    got = {(r.rule_id, r.event_id) for r in watch.watches(e, watch.rules_table(spark, "L0")).collect()}
    assert got == {("critical_sanctions", 1), ("default_events", 3)}
    found = spark.createDataFrame([("r", 1)], "rule_id string, event_id int")
    paths = spark.createDataFrame([(1, 2, 1, 0.5), (1, 3, 2, 0.4)], "start int, target int, depth int, confidence double")
    imp = spark.createDataFrame([(2, 0.6), (3, 0.4)], "event_id int, importance_score double")
    assert [r.target for r in watch.chain_watches(found, paths, imp).collect()] == [2]
    row = spark.range(1).select(watch.type_matches(F.lit("market_volatility"), F.lit("market_drop")).alias("a"), watch.type_matches(F.lit("stock_split"), F.lit("stock_up")).alias("b")).first()
    assert row.a and not row.b


def test_linking(spark):
    news = spark.createDataFrame([(1, "Сбербанк России и GAZP выросли"), (2, "ничего")], "id int, text_plain string")
    aliases = spark.createDataFrame([("сбербанк россии", "SBER"), ("газпром", "GAZP")], "alias string, ticker string")
    listed = spark.createDataFrame([("GAZP",), ("SBER",)], "ticker string")
    assert {(r.ticker, r.confidence) for r in nlp.link_companies(news, aliases, listed).collect()} == {("SBER", 0.95), ("GAZP", 1.0)}
    names = spark.createDataFrame([("ПАО «Сбербанк России»",), ("Норильский никель ПАО",), ("Совсем другое",)], "name string")
    sec = spark.createDataFrame([("GMKN", "Норильский никель"), ("SBER", "Сбербанк")], "ticker string, title string")
    got = {r.name: r.ticker for r in nlp.resolve_names(names, aliases, sec).collect()}
    assert got == {"ПАО «Сбербанк России»": "SBER", "Норильский никель ПАО": "GMKN"}


def test_names_go_through_the_steps_in_order(spark):
    """Every name against every security, without the join on heads of words."""
    from tidewater.functions import udfs
    from tidewater.plans import views

    v = views.Views(spark, "")
    clean = {r[0]: r[1] for r in spark.createDataFrame([(x,) for s in views.SECURITIES for x in s[1:3] if x] + [(x,) for x in [*views.ORGANISATIONS, "Яндэкс", "что-то иное"]], "n string").select("n", nlp.T.company_name(F.col("n"))).collect()}
    clean[None] = ""
    want = {}
    for name in [*views.ORGANISATIONS, "Яндэкс", "что-то иное"]:
        x, found = clean[name], []
        if x in views.dims.ALIASES:
            found.append((1, -0.95, views.dims.ALIASES[x], 0.95, "known_alias"))
        for ticker, title, full, isin, traded, kind, board in views.SECURITIES:
            points = 50 * (x in title.lower()) + 30 * (x in (full or "").lower()) + 20 * traded + 15 * (kind == "shares") + 10 * (board == "main") + 25 * bool(isin)
            if points >= 50 and any(w[:3] in {y[:3] for y in f"{clean[title]} {clean[full]}".split()} for w in x.split()):
                found.append((2, -points, ticker, 0.85, "auto_learned"))
            ratios = [udfs.name_ratios(x, clean[y]) for y in (title, full)]
            sim = [0.4 * a + 0.4 * b + 0.2 * c for a, b, c in ratios]
            near = sim[0] * (1.2 if traded else 1) * (1.1 if board == "main" else 1)
            if near > 0.7:
                found.append((3, -near, ticker, min(near, 1.0), "search"))
            alike = max([s for s, (_, b, _) in zip(sim, ratios, strict=True) if b >= 0.8], default=0)
            if alike > 0.7:
                found.append((4, -alike, ticker, 0.9 * alike, "fuzzy"))
        if found:
            want[name] = min(found)[2:]
    names = spark.createDataFrame([(x,) for x in [*views.ORGANISATIONS, "Яндэкс", "что-то иное"]], "name string")
    got = {r.name: (r.ticker, pytest.approx(r.confidence), r.method) for r in nlp.resolve_names(names, v.aliases(), v.securities()).collect()}
    assert got == want and {m for *_, m in want.values()} >= {"known_alias", "auto_learned", "search"}
    cached = spark.createDataFrame([("газпром нефть", "SIBN", 0.8, "old")], "clean string, ticker string, confidence double, method string")
    assert {r.name: r.ticker for r in nlp.resolve_names(names, v.aliases(), v.securities(), cached=cached).collect()}["Газпром нефть"] == "SIBN"


def test_search(spark):
    docs = spark.createDataFrame([(1, 1, 0.9, "red fox"), (2, 1, 0.1, "red red fox dog"), (3, 2, 0.5, "blue cat")], "id int, parent int, hotness double, text string")
    b = {r.id: r.score for r in search.bm25(docs, "id", "text", ["red"]).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    mean = 8 / 3
    assert b[2] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / mean)))
    vec = spark.createDataFrame([(1, 0.2), (3, 0.9)], "id int, score double")
    out = search.search(docs, "text", "red fox", vec, documents=2).collect()
    assert {r.parent for r in out} == {1, 2} and [r.final_score for r in out] == sorted((r.final_score for r in out), reverse=True)
    assert search.normalised(spark.createDataFrame([(1, 3.0), (2, 3.0)], "id int, score double")).agg(F.min("score")).first()[0] == 1.0


def test_sources(spark, tmp_path):
    (tmp_path / "n.json").write_text('[{"text": "t", "title": "x", "timestamp": 5, "url": "u", "source": "s"}, {"text": "t2", "date": "2024-01-01"}, {"text": "t3"}]')
    assert [r.time for r in files.read_news_json(spark, str(tmp_path / "n.json")).collect()] == ["5", "2024-01-01", ""]
    nodes = spark.createDataFrame([("a", ["X", "Y"], 1)], "id string, labels array<string>, n int")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    for fmt in ("json", "csv"):
        files.write_graph(nodes, edges, str(tmp_path / fmt), fmt)
        back = files.read_graph(spark, str(tmp_path / fmt / "nodes"), fmt).first()
        assert back.id == "a" and back.n == 1
    assert files.cypher(nodes.select("id", "n"), "Company", "id").first().statement.startswith("MERGE (n:Company {id: 'a'})")
    j = spark.createDataFrame([('{"columns": ["secid", "isin", "is_traded"], "data": [["A", "RU1", "0"], ["B", "", "0"], ["C", null, "1"]]}',)], "p string")
    assert sorted(r.m["secid"] for r in files.read_listing(j, "p").collect()) == ["A", "C"]
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, day string")
    files.write_partitioned(df, str(tmp_path / "p"), "day")
    assert spark.read.parquet(str(tmp_path / "p")).filter("day = '2024-01-02'").count() == 1


def test_sector_tree_of_every_taxonomy(spark):
    icb = {r.code: r.path for r in nlp.sector_tree(spark).collect()}
    assert icb["9010"] == "9000/9010" and len(icb) == 47
    assert {r.level for r in nlp.sector_tree(spark, "gics").collect()} == {1}


def test_draft_request_and_backfill(spark):
    from tidewater.plans import pipelines

    hits = spark.createDataFrame([(1, "u1", "text one"), (2, "u2", "text two"), (3, "u3", "three")], "final_position int, url string, text string")
    d = pipelines.draft_request(hits, "q" * 120).first()
    assert d.headline == "q" * 97 + "..." and d.sources == ["u1", "u2", "u3"] and d.summary == "text one text two"
    with pytest.raises(ValueError):
        pipelines.backfill_batches(hits, ["a"], 10, 5)


def test_aliases_recipients_profiles(spark):
    known = spark.createDataFrame([("a", "A1")], "alias string, ticker string")
    found = spark.createDataFrame([("a", "A2"), ("b", "B2"), ("b", "B1")], "alias string, ticker string")
    assert {tuple(r) for r in ingest.learned_aliases(known, found).collect()} == {("a", "A1"), ("b", "B1")}
    links = spark.createDataFrame([(1, "x"), (1, "y")], "id int, subject string")
    subs = spark.createDataFrame([("u", "x"), ("u", "y"), ("w", "z")], "user string, subject string")
    assert [tuple(r) for r in ingest.recipients(links, subs).collect()] == [(1, "u")]
    prices = spark.createDataFrame([(1, datetime.date(2024, 1, 1), 2.0, 1.0), (1, datetime.date(2024, 1, 2), 3.0, 1.0)], "secid int, day date, close double, volume double")
    companies = spark.createDataFrame([(1, "a"), (2, "b")], "secid int, name string")
    shares = spark.createDataFrame([(1, 10)], "secid int, shares long")
    assert {r.name: r.cap for r in market.company_profile(companies, prices, shares).collect()} == {"a": 30.0, "b": None}


def test_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from tidewater.session import shared_folder, stored

    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=conf.get), sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("spark://a:7077", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    local = session("local[2]")
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://a:7077"))
    assert stored(spark.range(3)).count() == 3


def test_near_sums_equal_counting(spark):
    rng = random.Random(18)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([None, *range(0, 500, 3)]) if i % 9 == 0 else rng.randint(-200, 500), rng.choice([0, 1, 5, None])) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, k string, us long, v int")
    spans = {"a": (50, 0), "b": (10, 0), "c": (50, -1), "d": (30, 70), "e": (-1, 40), "f": (-20, 40)}
    sums = near_sums(df, ["k"], "us", {n: (*s, F.col("v")) for n, s in spans.items()})
    assert sums.columns == [*df.columns, *spans]
    got = {r.id: r for r in sums.collect()}
    assert len(got) == len(rows)
    for i, k, u, v in rows:
        for n, (back, ahead) in spans.items():
            near = [x for _, k2, u2, x in rows if k2 == k and (u2 is None if u is None else u2 is not None and u - back <= u2 <= u + ahead)]
            assert got[i][n] == sum(x or 0 for x in near), (i, n)
        assert (got[i].k, got[i].us, got[i].v) == (k, u, v)


@pytest.mark.parametrize("name", ["event_burst", "l0_watches", "source_corroboration", "novelty_counts", "importance_score"])
def test_no_frame_is_read_for_every_row(spark, sf_dir, name):
    """A sliding frame costs its rows for each row: with the square of a busy day."""
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\((.*?)\)", plan)
    assert frames and all("unboundedpreceding" in f for f in frames)


def _prices(spark):
    rng = random.Random(4)
    rows = [(s, datetime.date(2024, 1, 1) + datetime.timedelta(d), 7.1 if s == 3 or (s == 4 and d < 20) else rng.choice([None, round(rng.uniform(1, 9), 3)]) if s == 5 else round(1e5 + rng.uniform(0, 9), 6)) for s in range(12) for d in range(40) if rng.random() < 0.7]
    rows += [(2, datetime.date(2024, 1, 3), 5.5), (6, datetime.date(2024, 1, 3), float("nan"))]
    return spark.createDataFrame(rows, "secid long, day date, close double")


def _by_rows(prices, least=10):
    """The pairs as rows that meet on a day."""
    rows, met = [tuple(r) for r in prices.collect()], {}
    for a, d, x in rows:
        for b, e, y in rows:
            if a < b and d == e:
                met.setdefault((a, b), []).append((x, y))
    out = {}
    for k, v in met.items():
        both = [(x, y) for x, y in v if x is not None and y is not None]
        xs, ys = zip(*both, strict=True) if both else ((), ())
        plain = both and not any(map(math.isnan, xs + ys)) and len(set(xs)) > 1 and len(set(ys)) > 1
        if len(v) >= least:
            out[k] = len(v), statistics.correlation(xs, ys) if plain else 0.0
    return out


@pytest.mark.parametrize("block", [4, 100])
def test_correlations_equal_rows_met_by_day(spark, monkeypatch, block):
    monkeypatch.setattr(market, "BLOCK", block)
    prices = _prices(spark)
    got = {(r.a, r.b): (r.n, r.rho) for r in market.correlations(prices).collect()}
    want = _by_rows(prices)
    assert got.keys() == want.keys() and len(want) == 66
    for k, (n, rho) in want.items():
        assert got[k][0] == n and abs(got[k][1] - rho) < 1e-6, k


def test_pairs_of_securities_are_not_made_of_days(spark, sf_dir):
    for name in ("pair_correlation", "sector_correlation"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "corr(" not in plan and not re.search(r"Join Inner, .*day", plan)


def test_correlation_in_groups(spark):
    groups = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(12)] + [(0, "a"), (1, "a")], "secid long, sector string")
    all_pairs = market.group_correlation(market.correlations(_prices(spark)), groups, "secid", "sector")
    assert sorted(market.correlation_in_groups(_prices(spark), groups, "secid", "sector").collect()) == sorted(all_pairs.collect())


def test_totals_of_pairs_without_making_them(spark, sf_dir):
    """The totals of causal_pairs(), by counting each cause's effects."""
    events = queries.Views(spark, sf_dir).events()
    pairs = ceg.causal_pairs(events, ["ticker"]).agg(F.count(F.lit(1)), F.countDistinct("cause_id"), F.round(F.sum("conf_total"), 3)).first()
    got = queries.QUERIES["event_graph_totals"](spark, sf_dir)
    assert tuple(got.first()) == tuple(pairs)
    assert "effect_id" not in got._jdf.queryExecution().analyzed().toString()


def test_recipients_meet_news_as_groups(spark, sf_dir):
    """Users of the same subjects are met with a news item once: the result's rows aren't made distinct."""
    links = spark.createDataFrame([(1, "A"), (1, "B"), (1, "A"), (2, "B"), (2, None), (None, "A"), (3, "C")], "id long, subject string")
    rows = [("u", "A"), ("u", "B"), ("v", "B"), ("v", "A"), ("v", "A"), ("w", "B"), ("x", None), (None, "A"), ("y", "D")]
    got = ingest.recipients(links, spark.createDataFrame(rows, "user string, subject string")).collect()
    want = {(i, u) for i, s in [tuple(r) for r in links.collect()] for u, t in rows if s is not None and s == t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    plan = queries.QUERIES["notified_users"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[id#\d+L?, user#\d+L?\]", plan)


def test_recipients_lie_in_blocks(spark, monkeypatch, tmp_path):
    """Users of a group are met block by block, whatever the sizes; files hold a pair in little space."""
    news, users = spark.range(4000), spark.range(3000)
    links = news.select("id", F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("subject"))
    subs = users.select((F.col("id") * 7919 % 1000003).alias("user"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("subject"))
    ingest.recipients(links, subs).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.distinct().count() == 6000000
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size < 0.3 * 6000000, size
    monkeypatch.setattr(ingest, "BLOCK", 4)
    monkeypatch.setattr(ingest, "LOT", 12)
    rng = random.Random(4)
    pairs = lambda n, m: [(rng.choice([None, *range(n)]), rng.choice("ABC")) for _ in range(m)]
    a, b = [*pairs(30, 60), (None, "A")], [*pairs(90, 200), (None, "A")]
    got = ingest.recipients(spark.createDataFrame(a, "id long, subject string"), spark.createDataFrame(b, "user int, subject string")).collect()
    want = {(i, u) for i, s in a for u, t in b if s == t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want and (None, None) in want


@pytest.mark.parametrize("block", [7, 4096])
def test_dense_vectors_equal_their_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph, "STRIP", 3)
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), [rng.uniform(-1, 1) for _ in range(5)]) for i in rng.sample(range(900), 60)]
    rows += [(1000 + i, "a", rows[0][2]) for i in range(9)] + [(2000, "a", [0.0] * 5), (2001, "b", [1.0, 0.0]), (2002, "b", [2.0, 0.0]), (2003, "b", [None, 1.0]), (2004, None, [1.0]), (2005, "b", None), (2006, "c", [1.0])]
    # exactly at the limit is not near
    rows += [(3000, "d", [1.0, 0.0]), (3001, "d", [3.0, 4.0]), (3002, "d", [0.6, 0.8])]
    vectors = spark.createDataFrame(rows, "id long, label string, v array<double>")
    for cosine, least in ((0.6, 2), (0.8, 3)):
        want = graph.dense_points(search.near_vectors(vectors, "id", "v", "label", cosine), least).collect()
        got = graph.dense_vectors(vectors, "id", "v", "label", cosine, least).collect()
        assert sorted(got) == sorted(want) and len(want) > 10


def test_density_clusters_make_no_pairs(spark, sf_dir):
    table = queries.Views(spark, sf_dir).table("embeddings")
    want = graph.dense_points(search.near_vectors(table, "vec_id", "embedding", "label", 0.3), 3).collect()
    assert sorted(queries.QUERIES["density_clusters"](spark, sf_dir).collect()) == sorted(want)
    copies = table.limit(5).withColumn("vec_id", F.col("vec_id") * 300).withColumn("vec_id", F.explode(F.sequence(F.col("vec_id"), F.col("vec_id") + 299)))
    made = []
    real = graph.stored
    graph.stored = lambda df, name="table": made.append(out := real(df, name)) or out
    try:
        assert graph.dense_vectors(copies, "vec_id", "embedding", "label", 0.3, 3).count() == 1500
    finally:
        graph.stored = real
    assert max(t.count() for t in made) <= 3000  # 1500 vectors; their pairs are 224250 and more


def test_only_events_of_watched_types_are_counted(spark, sf_dir):
    rules = watch.rules_table(spark, "L0")
    events = queries.Views(spark, sf_dir).events()
    events = events.unionByName(events.limit(3).withColumns({"id": -F.col("id") - 1, "event_type": F.lit("other")}))
    every = {r.id: r.n24 for r in ceg.bursts(events).collect()}
    got = watch.counted(events, rules).select("id", "n24", "event_type").collect()
    assert len(got) == len(every) - 3 and all(every[r.id] == r.n24 for r in got)
    # no running sum of six hours, which no rule asks for
    plan = queries.QUERIES["l0_watches"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "21600000001" not in plan and "leftsemi" in plan.lower(), plan


def test_importance_is_added_up_by_event_alone(spark, sf_dir):
    """Tickers, sectors and impacts of an event meet in one row of it: no window, no join by (id, ticker)."""
    plan = queries.QUERIES["importance_score"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "Expand" not in plan and not re.search(r"Join LeftOuter, \(\(id#\d+L? = [^)]*\) AND", plan)
    events = spark.createDataFrame([(1, ts(0), 0, "m&a", "A", "C", ["A", "B", "D"], 1, True), (2, ts(9), 9000000, "m&a", None, "C", [], 1, True)], "id long, ts timestamp, us long, event_type string, ticker string, company string, tickers array<string>, news_id long, is_anchor boolean")
    news = spark.createDataFrame([(1, "s")], "id long, source string")
    sources = spark.createDataFrame([("s", "html", 5)], "code string, kind string, trust_level int")
    sectors = spark.createDataFrame([("A", "x"), ("A", "y"), ("A", "y"), ("B", "x"), ("B", None)], "ticker string, sector string")
    impacts = spark.createDataFrame([(1, "A", 0.001, 2.0), (1, "A", 0.002, None), (1, "B", None, None), (2, "A", 0.1, 1.0)], "event_id long, ticker string, price_impact double, volume_impact double")
    got = {r.id: r for r in ceg.importance(events, news, sources, sectors, impacts).collect()}
    assert got[1].n_sectors == 2 and got[1].n_tickers == 3 and got[1].gains == pytest.approx(0.9)
    assert got[1].mean_impact == pytest.approx(got[1].most_impact / 2) and got[1].most_impact == pytest.approx(0.14)
    assert got[2].gains is None and got[2].price_impact == 0.0 and got[2].n_tickers is None


def test_effects_of_a_cause_share_the_search_for_evidence(spark, sf_dir):
    """What is looked for effect by effect, with names that few or half of the events have, equal
    times, other weights, linked types and repeated ids of companies."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    for types, half in ((["sanctions", "m&a", "rate_hike"], False), (["sanctions", "market_drop", "volatility_spike", "m&a"], True)):
        rows = []
        for i in rng.sample(range(5000), 400):
            who = "C0" if half and rng.random() < 0.5 else f"C{rng.randrange(60)}"
            weight = rng.choice([0.5, 0.5, 0.1234565, rng.random()])
            rows.append({"evidence_id": i, "evidence_us": rng.randrange(0, 86400, 300) * 1_000_000, "evidence_type": rng.choice(types), "ents": ["T", who] + (["X"] if rng.random() < 0.05 else []), "trust": 0.5, "weight": weight, "words": [who.lower()] if rng.random() < 0.9 else []})
        of = ceg._Cell(pa.Table.from_pylist(rows), 0.3, 5, 2 * ceg.HOUR)
        assert of.sparse
        asked = []

        def results(parts):
            return {(int(e), int(x)): (round(float(s), 9), bool(i), int(r)) for _, es, xs, ss, ins, rs in parts for e, x, s, i, r in zip(es, xs, ss, ins, rs)}

        each = of.each
        for c in range(0, 300, 37):
            effects = np.flatnonzero(of.us > of.us[c])
            want = results(each(c, effects))
            of.each = lambda c, e: (asked.append(len(e)), each(c, e))[1]
            assert results(of.shared(c, effects, 6)) == want and len(want) > 4 * len(effects)
            asked.append(-len(effects) if not half else 0)
            of.each = each
        assert half or sum(x for x in asked if x > 0) < 0.3 * -sum(x for x in asked if x < 0)
    e = queries.Views(spark, sf_dir).events()
    want = ceg.evidence(ceg.causal_pairs(e, ["ticker"]), e, ["ticker"], 86400)
    got = ceg.causal_evidence(e, ["ticker"])
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() > 1000
    # pairs aren't rows: events alone are dealt to cells
    assert "CoGroup" not in queries.QUERIES["evidence_scores"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert ceg._rounded(np.array([0.1234565, 0.1234564999, 0.3700000001, 0.625]), 6).tolist() == [0.123457, 0.123456, 0.37, 0.625]


def test_evidence_of_pairs_moves_no_pairs(spark, sf_dir):
    rng = random.Random(8)
    rows = [(i, ts(rng.randrange(0, 3 * 86400, 3600)), rng.choice(["sanctions", "other"]), rng.choice("AB")) for i in rng.sample(range(500), 120)]
    e = spark.createDataFrame(rows, "id long, ts timestamp, event_type string, ticker string")
    got = ceg.between(ceg.causal_pairs(e, ["ticker"], causes=ceg.following(e, ["ticker"], 86400), carried=["after"])).collect()
    of, want = {r[0]: r for r in rows}, set()
    for p in ceg.causal_pairs(e, ["ticker"]).collect():
        near = sorted((x[1], x[0]) for x in rows if x[3] == of[p.cause_id][3] and of[p.cause_id][1] < x[1] < of[p.effect_id][1])
        want |= {(p.cause_id, p.effect_id, i, rank) for rank, (_, i) in enumerate(near[:3], 1)}
    assert len(got) == len(want) > 100 and {(r.cause_id, r.effect_id, r.evidence_id, r["rank"]) for r in got} == want
    plan = queries.QUERIES["evidence_top3"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # each lag's join of causes and effects, and nothing after it but expressions
    above = plan[: plan.index("Join Inner")]
    assert "Aggregate" not in above and "Window" not in above and "Join" not in above


def test_pairs_past_the_first_evidence_are_not_searched(spark, sf_dir):
    """Also with repeated ids, which may name the cause or the effect."""
    rng = random.Random(9)
    at = lambda: ts(rng.randrange(0, 2 * 86400, 3600))
    rows = [(rng.randrange(40), at(), rng.choice(["sanctions", "other"]), rng.choice("AB")) for _ in range(120)]
    e = spark.createDataFrame(rows, "id long, ts timestamp, event_type string, ticker string")
    pairs = ceg.causal_pairs(e, ["ticker"], causes=ceg.following(e, ["ticker"], 86400), carried=["after"]).collect()
    want = []
    for p in pairs:
        near = [x for x in p.after if x.evidence_ts < p.effect_ts and x.evidence_id not in (p.cause_id, p.effect_id)]
        want += [(p.cause_id, p.effect_id, p.cause_ts, p.effect_ts, x.evidence_id, i) for i, x in enumerate(near[:3], 1)]
    got = ceg.between(ceg.causal_pairs(e, ["ticker"], causes=ceg.following(e, ["ticker"], 86400), carried=["after"]))
    assert sorted((r.cause_id, r.effect_id, r.cause_ts, r.effect_ts, r.evidence_id, r["rank"]) for r in got.collect()) == sorted(want) and len(want) > 300
    plan = queries.QUERIES["evidence_top3"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(CASE WHEN" in plan
