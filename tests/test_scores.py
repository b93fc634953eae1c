"""Formula fixtures with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import scores as S
from tidewater.operators import ceg, ingest

L = F.lit


def cases():
    N = L(None).cast("double")
    return [
        (S.burst(L(1)), 0.1),
        (S.burst(L(2)), 0.1),
        (S.burst(L(5)), 0.263902),
        (S.burst(L(11)), 0.501187),
        (S.burst(L(28)), 1.0),
        (S.time_factor(L(2.0)), 1.0),
        (S.time_factor(L(24.0)), 0.829669),
        (S.time_factor(L(48.0)), 0.442039),
        (S.time_factor(L(72.0)), 0.3),
        (S.time_factor(L(73.0)), 0.3),
        (S.time_factor(L(0.05)), 0.3),
        (S.link_confidence(L(0.5), L(1.0), L(0.5), L(0.5), L(0)), 0.55),
        (S.link_confidence(L(0.8), L(0.3), L(0.9), L(0.9), L(3)), 0.745),
        (S.causal_total(L(0.75), L(0.0), L(0.0)), 0.3),
        (S.causal_total(L(0.65), L(0.8), L(0.0)), 0.5),
        (S.market_confidence(L(2.5), L(True)), 0.622459),
        (S.market_confidence(L(3.0), L(True)), 0.731059),
        (S.market_confidence(L(5.0), L(True)), 0.952574),
        (S.market_confidence(L(5.0), L(False)), 0.0),
        (S.impact_weight(L(0.06), L(0.6), N, L(0)), 1.0),
        (S.impact_weight(L(-0.07), L(1.0), N, L(10)), -0.441455),
        (S.impact_weight(L(0.01), L(0.1), N, L(1)), 0.429989),
        (S.prediction_probability(L(0.7), L(0.8), L(0.0), L(False), L(0)), 0.805),
        (S.prediction_probability(L(0.4), L(0.9), L(0.5), L(True), L(5)), 0.62),
        (S.prediction_probability(L(0.7), L(1.0), L(1.0), L(True), L(9)), 0.95),
        (S.novelty(S.novelty_gain(L(0)), L("sanctions")), 0.83),
        (S.novelty(S.novelty_gain(L(1)), L("dividends")), 0.51),
        (S.novelty(S.novelty_gain(L(2)), L("other")), 0.521),
        (S.novelty(N, L("other")), 0.5),
        (S.blend(L(0.85), L(0.5)), 0.745),
        (S.corroboration(L(0), L(0)), -0.2),
        (S.decay(L(10)), 0.367879),
        (S.retry_delay(L(1)).cast("double"), 60),
        (S.retry_delay(L(2)).cast("double"), 120),
        (S.cosine(F.array(L(1.0), L(0.0)), F.array(L(1.0), L(1.0))), 0.707107),
        (ceg.temporal_proximity(L(0), L(5), L(10)), 1.0),
        (ceg.temporal_proximity(L(0), L(10), L(10)), 0.0),
        (ceg.semantic_relevance(L("market_drop"), L("sanctions"), L("other")), 1.0),
        (ceg.title_trust(L("Meduza: слухи")), 0.3),
    ]


def test_values(spark):
    row = spark.range(1).select(*[F.round(c, 6).alias(f"c{i}") for i, (c, _) in enumerate(cases())]).first()
    for i, (_, want) in enumerate(cases()):
        assert row[f"c{i}"] == pytest.approx(want, abs=2e-6), i


def test_boundaries_keep_operand_order(spark):
    row = spark.range(1).select((S.causal_total(L(0.75), L(0.0), L(0.0)) >= 0.3).alias("a"), S.causal_kind(L(0.75), L(0.0)).alias("k"), S.retry_delay(L(3)).alias("r"), S.priority(L(0.7)).alias("p")).first()
    assert (row.a, row.k, row.r, row.p) == (True, "RETRO", None, "high")


@pytest.mark.parametrize("trust,want", [(5, (True, 7.0, ["keyword:casino_keywords", "keyword:discount_keywords"])), (7, (False, 7.0, ["keyword:casino_keywords", "keyword:discount_keywords"])), (9, (False, 0.0, []))])
def test_spam(spark, trust, want):
    s = spark.range(1).select(ingest.spam(L("казино промокод"), L(trust)).alias("s")).first().s
    assert (s.is_ad, s.score, s.reasons) == want


def test_spam_structure(spark):
    text = "#Реклама https://bit.ly/a https://x.tk/?utm_source=1 https://cbr.ru/x https://d.com"
    s = spark.range(1).select(ingest.spam(L(text), L(5)).alias("s")).first().s
    assert s.score == 3.0 + 1.5 + 2.0 + 2.0 - 2.0 + 2.0
    assert "structural:many_urls" in s.reasons and "hashtag:ad_hashtags" in s.reasons
