"""Scores and formulas, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.plans import dims


def lookup(key: Column, table: dict, default) -> Column:
    """A value by key from a small map, else the default."""
    if not table:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key), F.lit(default))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def burst(n: Column, recent: Column | None = None) -> Column:
    """0.1 under two events, else (n - 1)^0.7 / 10 up to 1; 0.3 more if over 70 % are recent."""
    base = F.when(n < 2, 0.1).otherwise(F.least(F.pow(F.greatest(n - 1, F.lit(0)), F.lit(0.7)) / 10, F.lit(1.0)))
    if recent is None:
        return base
    return F.least(base + F.when(recent > 0.7 * n, 0.3).otherwise(0.0), F.lit(1.0))


def time_factor(hours: Column) -> Column:
    """Bell curve around two hours with 36 hours' spread, 0.3 at least; 1 from 5 minutes to 2 hours, 0.3 outside 5 minutes to 72 hours."""
    bell = F.exp(-F.pow(hours - 2, F.lit(2)) / (2 * 36.0 * 36.0))
    return F.when((hours < 5 / 60) | (hours > 72), 0.3).otherwise(F.greatest(bell, F.lit(0.3)))


def link_confidence(base: Column, time: Column, importance_cause: Column, importance_effect: Column, evidence: Column) -> Column:
    """0.4 base + 0.25 time + 0.2 importance + 0.15 evidence."""
    imp = F.least(2 * importance_cause * importance_effect, F.lit(1.0))
    ev = F.least(evidence / 3.0, F.lit(1.0))
    return clip(0.4 * base + 0.25 * time + 0.2 * imp + 0.15 * ev, 0.0, 1.0)


def causal_total(prior: Column, text: Column, market: Column) -> Column:
    """0.4 prior + 0.3 text + 0.3 market, added in this order."""
    return 0.4 * prior + 0.3 * text + 0.3 * market


def causal_kind(prior: Column, text: Column) -> Column:
    return F.when((prior >= 0.6) & (text >= 0.6), "CONFIRMED").when(prior >= 0.5, "RETRO").otherwise("HYPOTHESIS")


def market_confidence(z: Column, significant: Column) -> Column:
    """1 / (1 + e^(2 - z)) if significant, else 0."""
    return F.when(significant, 1 / (1 + F.exp(2 - z))).otherwise(0.0)


def impact_score(abnormal: Column, sigma: Column) -> Column:
    return F.least(F.abs(abnormal) / (sigma + 1e-6), F.lit(1.0))


def relative_change(before: Column, after: Column) -> Column:
    """(after - before) / before; null without a positive start."""
    return F.when(before > 0, (after - before) / F.nullif(before, F.lit(0.0)))


def decay(hours: Column, rate: float = 0.1) -> Column:
    return F.exp(-rate * hours)


def impact_weight(price: Column, volume: Column, volatility: Column, hours: Column, sigma: float = 0.03) -> Column:
    """Signed strength of a price move, clipped to [-1, 1]; missing changes count as none."""
    zero = F.lit(0.0)
    vol = F.coalesce(volatility, zero)
    f = (
        F.least(F.abs(price) / 0.02, F.lit(1.0)) + 0.3 * F.least(F.abs(F.coalesce(volume, zero)) / 0.5, F.lit(1.0))
        + 0.2 * F.least(F.abs(vol) / 0.1, F.lit(1.0)) + 0.2 * F.least(F.abs(price / sigma) / 1.96, F.lit(1.0))
    )
    return clip(F.signum(price) * f * decay(hours) * 0.8, -1.0, 1.0)


def impact_confidence(z: Column, volume_before: Column, volume_after: Column) -> Column:
    return F.least(0.5 + F.when(F.abs(z) > 1.96, 0.3).otherwise(0.0) + F.when((volume_before > 1e6) & (volume_after > 1e6), 0.2).otherwise(0.0), F.lit(1.0))


def impact_significant(price: Column, volume: Column, volatility: Column, z: Column) -> Column:
    """All thresholds; a volatility change that is null or zero isn't asked for."""
    ok = (F.abs(price) >= 0.02) & (F.abs(F.coalesce(volume, F.lit(0.0))) >= 0.5) & (F.abs(z) >= 1.96)
    return ok & (volatility.isNull() | (volatility == 0) | (F.abs(volatility) >= 0.1))


def prediction_probability(base: Column, importance: Column, price_impact: Column, market_like: Column, connections: Column) -> Column:
    """Base odds times a multiplier in [0.5, 2], 0.95 at most."""
    m = 1 + 0.5 * (importance - 0.5) + F.when(market_like, 0.3 * price_impact).otherwise(0.0) + 0.2 * F.least(connections / 5.0, F.lit(1.0))
    return F.least(base * clip(m, 0.5, 2.0), F.lit(0.95))


def blend(rerank: Column, hotness: Column, weight: float = 0.3) -> Column:
    return rerank * (1 - weight) + F.coalesce(hotness, F.lit(0.5)) * weight


def retry_delay(attempt: Column, limit: int = 3) -> Column:
    """Seconds until the next attempt: 60 doubled each time; null at the limit."""
    return F.when(attempt < limit, 60 * F.pow(F.lit(2), attempt - 1)).cast("long")


def novelty_gain(n: Column) -> Column:
    """What one ticker adds, by the number of like events before."""
    return F.when(n == 0, 0.3).when(n == 1, 0.1).otherwise(0.05 * F.greatest(5 - n, F.lit(0)) / 5)


def rarity(event_type: Column) -> Column:
    return lookup(event_type, dims.RARITY, dims.DEFAULT_RARITY)


def novelty(gains: Column, event_type: Column) -> Column:
    """0.7 (0.5 + what the tickers add) + 0.3 rarity, 1 at most; 0.5 alone without tickers."""
    return F.when(gains.isNull(), F.lit(0.35) + 0.3 * rarity(event_type)).otherwise(F.least(0.7 * (0.5 + gains) + 0.3 * rarity(event_type), F.lit(1.0)))


def credibility(trust: Column, kind: Column, event_type: Column, anchor: Column, corroboration: Column) -> Column:
    bonus = F.when(kind == "telegram", F.when(trust >= 8, 0.2).when(trust >= 6, 0.1).otherwise(0.0)).otherwise(0.0)
    return clip(
        0.5 + 0.1 * (trust - 5) + bonus + F.when(event_type.isin(dims.CREDIBLE_TYPES), 0.2).otherwise(0.0)
        + F.when(anchor, 0.15).otherwise(0.0) + 0.1 * corroboration, 0.0, 1.0,
    )


def corroboration(kinds: Column, others: Column) -> Column:
    """0.3 for each kind of source, up to 1, and 0.2 for each event after the first, up to 1; -0.2 without any."""
    return F.least(0.3 * kinds, F.lit(1.0)) + F.least(0.2 * (others - 1), F.lit(1.0))


def breadth(names: Column, diversity: Column, event_type: Column) -> Column:
    tier = F.when(names <= 1, 0.1).when(names <= 3, 0.3).when(names <= 10, 0.6).otherwise(0.9)
    return F.least(tier + 0.2 * diversity + F.when(event_type.isin(dims.BROAD_TYPES), 0.2).otherwise(0.0), F.lit(1.0))


def price_impact(abnormal: Column, volume_ratio: Column) -> Column:
    return F.least(70 * F.abs(abnormal) + 0.3 * F.greatest(volume_ratio - 1, F.lit(0.0)) / 5, F.lit(1.0))


def mean_price_impact(mean: Column, most: Column) -> Column:
    """The tickers' mean, 0.2 more if one exceeds 0.7, 1 at most; 0 without any."""
    return F.when(mean.isNull(), 0.0).otherwise(F.least(mean + F.when(most > 0.7, 0.2).otherwise(0.0), F.lit(1.0)))


def importance(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the five components, clipped to [0, 1]; weights are scaled to sum to 1."""
    w = weights or dims.IMPORTANCE_WEIGHTS
    total = sum(w.values())
    out = F.lit(0.0)
    for name in w:
        out = out + parts[name] * (w[name] / total)
    return clip(out, 0.0, 1.0)


def band(x: Column, edges: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first edge that x reaches."""
    out = F.lit(rest)
    for edge, name in sorted(edges):
        out = F.when(x >= edge, name).otherwise(out)
    return out


def priority(x: Column) -> Column:
    return band(x, [(0.9, "critical"), (0.7, "high"), (0.5, "medium")], "low")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of one length; null if either has no length."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def density_score(links: Column, nodes: Column) -> Column:
    return F.least(10.0 * links / F.nullif(nodes, F.lit(0)), F.lit(10.0))
