"""Text functions, with Cyrillic inputs that the tables don't have."""

import pytest
import datetime

from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import nlp


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_language_and_titles(spark):
    for text, want in (("abc где", "unknown"), ("где", "ru"), ("12", "unknown"), ("abcd где", "en")):
        assert value(spark, T.script_language(F.lit(text))) == want
    long = "x" * 250
    assert value(spark, T.title_of(F.lit(long + "\nrest"))) == "x" * 197 + "..."
    assert value(spark, T.title_of(F.lit(""))) == "(untitled)"
    assert value(spark, T.truncate(F.lit("one two three four"), 12)) == "one two..."


def test_names_tickers_countries(spark):
    assert value(spark, T.company_name(F.lit("ПАО «Сбербанк России»"))) == "сбербанк россии"
    assert value(spark, T.ticker_tokens(F.lit("sber и GAZP"))) == ["SBER", "GAZP"]
    assert value(spark, T.countries_in(F.lit("Россия и Китай, USA"))) == ["CN", "RU", "US"]
    assert value(spark, nlp.countries(F.lit("Germany"), F.lit("текст про Японию"), language=F.lit("ru"))) == ["DE", "RU"]
    assert value(spark, T.keywords(F.lit("Рост цен и ABC на нефть"))) == ["рост", "нефть"]


def test_tickers_upper_case_letter_by_letter(spark):
    got = value(spark, T.ticker_tokens(F.lit("größe essung straßen oﬃce SBER\u0301 lkoh½ gazp")))
    assert got == ["ESSUNG", "SBER", "GAZP"]


def test_numbers(spark):
    m = value(spark, T.money(F.lit("Выручка 12,5 млрд руб и $45 и 100 тыс. долларов")))
    assert [(x.amount, x.currency) for x in m][0] == (12.5e9, "RUB")
    assert (100e3, "USD") in [(x.amount, x.currency) for x in m]
    p = value(spark, T.percents(F.lit("рост +3.2% YoY, минус -50 bps")))
    assert [(x.value, x.basis_points, x.basis) for x in p] == [(3.2, False, "YoY"), (-50.0, True, None)]
    q = value(spark, T.quantities(F.lit("добыли 1000 тонн и 2 млн баррелей")))
    assert [(x.amount, x.unit) for x in q] == [(1000.0, "тонн"), (2e6, "баррел")]
    assert value(spark, T.periods(F.lit("за 9М2025, Q3 2024 и FY2024"))) == ["9М2025", "Q3 2024", "FY2024"]
    assert value(spark, T.dates(F.lit("15 января 2025, 2025-01-15, 15.01.2025"))) == ["15 января 2025", "2025-01-15", "15.01.2025"]
    assert value(spark, F.size(T.financial_bag(F.lit("10 руб, 10 руб, 5%, Q3 2024")))) == 3


def test_web(spark):
    html = "<html><title>T &amp; t</title><script>x<p></script><article><h1>Head</h1><p onclick='a'>Text&nbsp;one</p></article><time datetime='2024-01-02'></html>"
    f = value(spark, T.page_fields(F.lit(html)))
    assert (f.title, f.published, f.content) == ("Head", "2024-01-02", "Head Text one")
    assert "onclick" not in value(spark, T.sanitise_html(F.lit(html)))
    assert value(spark, T.main_content(F.lit("<div>a</div><div>longer</div>"))) == "longer"
    assert value(spark, T.urls_in(F.lit("see https://b.ru and http://a.ru/x https://b.ru"))) == ["http://a.ru/x", "https://b.ru"]
    assert value(spark, T.hashtags_in(F.lit("#реклама и #ad"))) == ["#реклама", "#ad"]
    assert value(spark, T.document_type(F.lit("https://x.com/news/1"))) == "news"


def test_encoding_json_and_dates(spark):
    broken = "привет".encode().decode("latin-1")
    assert value(spark, T.repair_mojibake(F.lit(broken))) == "привет"
    assert value(spark, T.repair_mojibake(F.lit("привет"))) == "привет"
    assert value(spark, T.unfence(F.lit('text ```json\n{"a": {"b": 1}}\n``` end'))) == '{"a": {"b": 1}}'
    assert value(spark, T.publish_time(F.lit("15.01.2025 10:30"))) == datetime.datetime(2025, 1, 15, 10, 30)
    assert value(spark, T.publish_time(F.lit("soon"), F.lit("2024-01-01").cast("timestamp"))) == datetime.datetime(2024, 1, 1)
    assert value(spark, T.causal_confidence(F.lit("Падение из-за санкций, на фоне"))) == 0.8
    assert value(spark, T.clean_article(F.lit("short\nA line that is long enough\nSubscribe to our channel now"), 20, ["subscribe"])) == "A line that is long enough"


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(1234))
    chunks = value(spark, T.stride_chunks(F.lit(text), 500, 100))
    assert chunks == [text[i : i + 500] for i in range(0, 1134, 400)]
    assert value(spark, T.stride_chunks(F.lit(""), 500, 100)) == []
    assert value(spark, T.stride_chunks(F.lit("ab"), 500, 100)) == ["ab"]


def test_identifiers_and_similarity(spark):
    assert value(spark, T.market_of(F.lit("moex:SBER"))) == "moex" and value(spark, T.ticker_of(F.lit("moex:SBER"))) == "SBER"
    assert [value(spark, T.provider_of(F.lit(s))) for s in ("BTC/USD", "ETH", "SBER", "AAPL.US")] == ["crypto", "crypto", "exchange", "world"]
    assert value(spark, T.ratio(F.lit("abcd"), F.lit("abcd"))) == 1.0
    from tidewater.functions import udfs

    assert udfs.name_ratios("bank one", "one bank") == (0.5, 1.0, 0.67)
    assert udfs.name_ratios("роснефть", "нк роснефть") == (pytest.approx(16 / 19), 0.84, 1.0) and udfs.name_ratios("", "a") == (0.0, 0.0, 0.0)
    got = spark.range(1).select(udfs.name_similarity(F.lit("bank one"), F.lit("one bank")).alias("s")).first().s
    assert (got.words, got.similarity) == (1.0, pytest.approx(0.4 * 0.5 + 0.4 + 0.2 * 0.67))
    assert value(spark, T.listing_score(F.lit("sber"), F.lit("Sberbank"), F.lit("PJSC Sber"), F.lit("RU1"), F.lit(True), F.lit("shares"), F.lit("main"))) == 150


def test_classifier_follows_the_order_of_rules(spark):
    def kind(title, companies):
        c = value(spark, nlp.news_type(F.lit(title), F.lit(""), F.lit(companies)))
        return c.news_type, c.news_subtype

    assert kind("Сбербанк получил рекордную прибыль", 1) == ("one_company", "earnings")
    assert kind("Рост добычи на 15%", 1) == ("one_company", None)
    assert kind("Рынок вырос, санкции не влияют", 0) == ("market", None)
    assert kind("Яндекс: искусственный интеллект", 1) == ("one_company", "legal")
    assert kind("ЦБ повысил ключевую ставку", 0) == ("regulatory", None)
    assert kind("Хакеры атаковали", 0) == (None, "hack")


def test_events(spark):
    e = value(spark, nlp.event_types(F.lit("ЦБ повысил ставку"), F.lit("")))
    assert [(x.event_type, x.hits, round(x.confidence, 6)) for x in e] == [("rate_hike", 1, 0.8)]
    assert value(spark, nlp.event_types(F.lit("ничего"), F.lit("")))[0].event_type == "news_general"
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(c).alias("confidence")) for a, b, c in ((0, 5, 0.9), (3, 8, 0.95), (10, 12, 0.8))])
    assert [(s.start, s.stop) for s in value(spark, nlp.resolve_spans(spans))] == [(3, 8), (10, 12)]
    assert value(spark, nlp.sector_of_ticker(F.lit("TCSG"))) == "9510"
    assert value(spark, nlp.sector_of_words(F.array(F.lit("слово"), F.lit("нефтегаз")))) == "1010"
    assert value(spark, nlp.topics(F.lit("Банк и нефть")))[0].topic == "энергетика"
    s = value(spark, nlp.sentiment(F.lit("good bad good"), ["good"], ["bad", "worse"]))
    assert (s.label, s.score) == ("NEUTRAL", 0.5)
    sig = value(spark, nlp.signals(F.lit("NEGATIVE"), F.lit(0.95), F.lit("x"), F.array(F.lit("A")), ["default"]))
    assert [(x.company, x.signal) for x in sig] == [("A", "SELL")]


def test_entities(spark):
    e = value(spark, nlp.entities(F.lit("Сбербанк и Газпром на MOEX: прибыль 100 млрд руб")))
    assert {(c.name, c.ticker) for c in e.companies} == {("СБЕРБАНК", "SBER"), ("ГАЗПРОМ", "GAZP")}
    assert [(m.name, m.type) for m in e.markets] == [("MOEX", "биржа")]
    assert [(m.metric_type, m.value) for m in e.financial_metrics] == [("прибыль", 100e9)]


def test_udfs(spark):
    from tidewater.functions import udfs

    text = "\n\n".join(" ".join(f"word{i}{j}" for j in range(30)) for i in range(5)) + "\n\n" + "y" * 700
    for size, overlap in ((100, 20), (300, 50), (50, 0)):
        chunks = udfs.split_recursively(text, size, overlap)
        assert all(0 < len(c) <= size for c in chunks)
        assert all(w in " ".join(chunks) for w in text.split()[:-1])
    assert "".join(udfs.split_recursively("y" * 700, 100, 0)) == "y" * 700
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string")
    got = {r.id: r.c for r in df.select("id", udfs.recursive_chunks(F.col("t"), 100, 20).alias("c")).collect()}
    assert got == {1: udfs.split_recursively(text, 100, 20), 2: [], 3: []}
    pairs = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string")
    assert [r.v for r in pairs.select(udfs.sequence_ratio(F.col("a"), F.col("b")).alias("v")).collect()] == [0.75, None]
    j = spark.createDataFrame([('x {"a": "}", "b": {"c": 1}} y {',), ("none",), (None,)], "t string")
    assert [r.v for r in j.select(udfs.balanced_json(F.col("t")).alias("v")).collect()] == ['{"a": "}", "b": {"c": 1}}', None, None]
    udfs.parsers.register("site", T.page_fields)
    assert udfs.parsers.names() == ["site"] and udfs.parsers["site"] is T.page_fields
