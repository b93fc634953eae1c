"""Prices: returns, as-of impact, correlations, event studies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import scores as S
from tidewater.plans.joins import asof_join
from tidewater.session import ship_package, stored


def returns(prices: DataFrame) -> DataFrame:
    """prices with the simple return on the day before; null after a missing or non-positive price."""
    before = F.lag("close").over(Window.partitionBy("secid").orderBy("day"))
    return prices.withColumn("ret", F.when(before > 0, (F.col("close") - before) / F.nullif(before, F.lit(0.0))))


def last_price(prices: DataFrame) -> DataFrame:
    return prices.groupBy("secid").agg(F.max_by("close", "day").alias("close"), F.max("day").alias("day"), F.round(F.avg("volume"), 6).alias("mean_volume"))


#: Securities on each side of a cell of pairs, and days that are multiplied at once.
BLOCK = 2048
DAYS = 512


def _correlated(cell: pa.Table, least: int) -> pa.Table:
    """Pairs of one cell with at least `least` common days, by products of matrices (security, day).

    Rows: side, secid, days, closes. In a cell of two blocks only pairs across are made."""
    side = cell.column("side").to_numpy()
    ids = cell.column("secid").combine_chunks()
    size = pc.list_value_length(cell.column("days").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
    day_names, day = np.unique(cell.column("days").combine_chunks().flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    close = cell.column("closes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    null = pc.is_null(cell.column("closes").combine_chunks().flatten()).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(close) & ~null  # a pair that meets one has no correlation
    good = ~(null | bad)
    owner = np.repeat(np.arange(len(size)), size)
    # levels from each security's first: a constant one is exactly zero
    first = np.zeros(len(size))
    at = np.flatnonzero(good)[::-1]
    first[owner[at]] = close[at]
    x = np.where(good, close - first[owner], 0.0)
    scale = np.sqrt(np.bincount(owner, x * x, len(size)))
    x /= np.where(scale > 0, scale, 1.0)[owner]
    two = bool(side.max(initial=0))
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(size)),) * 2
    sums = {k: np.zeros((len(a), len(b))) for k in ("n", "m", "x", "y", "xx", "yy", "xy")}
    holes = bool((~good).any())
    broken = np.zeros((len(a), len(b))) if bad.any() else None
    order = np.argsort(day, kind="stable")
    for start in range(0, len(day_names), DAYS):
        rows = order[slice(*np.searchsorted(day[order], [start, start + DAYS]))]

        def matrix(v, rows=rows, start=start):
            out = np.zeros((len(size), min(DAYS, len(day_names) - start)))
            np.add.at(out, (owner[rows], day[rows] - start), v[rows])
            return out

        c, v, q = matrix(good.astype(float)), matrix(x), matrix(x * x)
        sums["m"] += c[a] @ c[b].T
        sums["x"] += v[a] @ c[b].T
        sums["y"] += c[a] @ v[b].T
        sums["xx"] += q[a] @ c[b].T
        sums["yy"] += c[a] @ q[b].T
        sums["xy"] += v[a] @ v[b].T
        if holes:
            every = matrix(np.ones(len(day)))
            sums["n"] += every[a] @ every[b].T
        if broken is not None:
            wrong, real = matrix(bad.astype(float)), matrix((~null).astype(float))
            broken += wrong[a] @ real[b].T + real[a] @ wrong[b].T
    n = sums["n"] if holes else sums["m"]
    i, j = np.nonzero((n >= least) & (True if two else np.triu(np.ones(n.shape, bool), 1)))
    m, sx, sy, sxx, syy, sxy = (sums[k][i, j] for k in ("m", "x", "y", "xx", "yy", "xy"))
    n = n[i, j]
    m = np.maximum(m, 1)
    vx, vy = sxx - sx * sx / m, syy - sy * sy / m
    flat = (vx <= 1e-9 * sxx) | (vy <= 1e-9 * syy)
    rho = np.where(flat, 0.0, (sxy - sx * sy / m) / np.sqrt(np.where(flat, 1.0, vx * vy)))
    # nearly constant over the common days: worked out from the values themselves
    edges = np.concatenate([[0], np.cumsum(size)])
    for k in np.flatnonzero(flat & (sxx > 0) & (syy > 0)):
        p, r = a[i[k]], b[j[k]]
        of = [s[good[s]] for s in (np.arange(edges[p], edges[p + 1]), np.arange(edges[r], edges[r + 1]))]
        left, right = np.nonzero(day[of[0]][:, None] == day[of[1]][None, :])
        u, w = close[of[0][left]], close[of[1][right]]
        if np.ptp(u) and np.ptp(w):
            u, w = u - u.mean(), w - w.mean()
            rho[k] = (u @ w) / np.sqrt((u @ u) * (w @ w))
    if broken is not None:
        rho[broken[i, j] > 0] = 0.0
    left, right = ids.take(pa.array(a[i])), ids.take(pa.array(b[j]))
    swap = pc.greater(left, right)
    weight = cell.column("weight").to_numpy()
    return pa.table({"a": pc.if_else(swap, right, left), "b": pc.if_else(swap, left, right), "n": n.astype(np.int64), "rho": np.clip(rho, -1.0, 1.0), "weight": weight[a[i]] * weight[b[j]]})


def correlations(prices: DataFrame, least: int = 10, groups: DataFrame | None = None) -> DataFrame:
    """Pearson correlation of close levels of pairs over common days; at least `least` days.

    Each security becomes one row with all its days. Blocks of securities meet in cells, and
    a cell's sums over common days are products of matrices (security, day), so what meets on
    a day is never a row. With groups (k, g), pairs of each group only, with g and `weight`,
    how often the groups list the pair.
    """
    date = prices.schema["day"].dataType.simpleString() == "date"
    day = F.unix_date("day") if date else F.col("day")
    known = prices.filter("secid is not null and day is not null")
    series = known.groupBy("secid").agg(F.collect_list(F.struct(day.alias("d"), F.col("close").cast("double").alias("c"))).alias("s"))
    series = stored(series.select("secid", F.col("s.d").alias("days"), F.col("s.c").alias("closes")), "series")
    kind = prices.schema["secid"].dataType.simpleString()
    if groups is None:
        placed, by = series.withColumns({"g": F.lit(0), "weight": F.lit(1).cast("long")}), "int"
    else:
        listed = groups.filter("k is not null and g is not null").groupBy("k", "g").agg(F.count(F.lit(1)).alias("weight"))
        placed, by = series.join(listed, F.col("secid") == F.col("k")).drop("k"), groups.schema["g"].dataType.simpleString()
    blocks = placed.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("secid"), F.col("parts")).cast("int")
    cells = placed.join(F.broadcast(blocks), "g").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "g", F.least("mine", "other").alias("c1"), F.greatest("mine", "other").alias("c2"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "secid", "weight", "days", "closes"
    )
    ship_package(prices.sparkSession)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        out = _correlated(rows, least)
        return out.append_column("g", pa.array([key[0].as_py()] * out.num_rows, rows.schema.field("g").type)).select(["g", "a", "b", "n", "rho", "weight"])

    pairs = cells.groupBy("g", "c1", "c2").applyInArrow(run, f"g {by}, a {kind}, b {kind}, n long, rho double, weight long")
    out = pairs.select("g", "a", "b", "n", F.round("rho", 6).alias("rho"), F.round(F.least(F.col("n") / 252, F.lit(1.0)), 6).alias("confidence"), "weight")
    return out.drop("g", "weight") if groups is None else out


def correlation_in_groups(prices: DataFrame, groups: DataFrame, key: str, group: str, least: int = 10) -> DataFrame:
    """group_correlation() of correlations(), of which only pairs inside a group are worked out."""
    pairs = correlations(prices, least, groups.select(F.col(key).alias("k"), F.col(group).alias("g")))
    mean = F.sum(F.abs("rho") * F.col("weight")) / F.sum("weight")
    return pairs.groupBy(F.col("g").alias(group)).agg(F.sum("weight").alias("pairs"), F.round(mean + 1e-9, 6).alias("mean_rho"))


def group_correlation(pairs: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """Mean absolute correlation of the pairs inside each group."""
    g = groups.select(F.col(key).alias("k"), F.col(group).alias("g"))
    ga, gb = g.select(F.col("k").alias("a"), F.col("g").alias("ga")), g.select(F.col("k").alias("b"), F.col("g").alias("gb"))
    both = pairs.join(ga, "a").join(gb, "b").filter("ga = gb")
    return both.groupBy(F.col("ga").alias(group)).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.abs("rho")) + 1e-9, 6).alias("mean_rho"))


def price_impact(events: DataFrame, prices: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """For each event (id, secid, ts) and window: the last price at or before the event within
    the lookback, the last within the window after it, and the change.

    windows: name -> (seconds after, seconds of lookback).
    """
    w = F.explode(F.array(*[F.struct(F.lit(k).alias("window"), F.lit(a).alias("ahead"), F.lit(b).alias("back")) for k, (a, b) in sorted(windows.items())]))
    e = events.select("id", "secid", "ts", w.alias("w")).select("id", "secid", "ts", "w.*")
    p = prices.select("secid", F.col("ts").alias("pts"), F.col("close").alias("before"), F.col("volume").alias("volume_before"))
    got = asof_join(e, p, ["secid"], "ts", "pts", ["before", "volume_before"])
    old = F.unix_timestamp("ts") - F.unix_timestamp("pts_matched") > F.col("back")
    got = got.withColumn("before", F.when(~old, F.col("before"))).withColumn("volume_before", F.when(~old, F.col("volume_before"))).drop("pts_matched")
    got = got.withColumn("until", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("ahead")))
    p2 = prices.select("secid", F.col("ts").alias("pts"), F.col("close").alias("after"), F.col("volume").alias("volume_after"))
    got = asof_join(got, p2, ["secid"], "until", "pts", ["after", "volume_after"])
    stale = F.col("pts_matched") < F.col("ts")
    got = got.withColumn("after", F.when(~stale, F.col("after"))).withColumn("volume_after", F.when(~stale, F.col("volume_after")))
    change = S.relative_change(F.col("before"), F.col("after"))
    return got.select("id", "secid", "window", "before", "after", "volume_before", "volume_after", change.alias("change"))


def event_study(events: DataFrame, prices: DataFrame, estimation: int = 30, least: int = 10) -> DataFrame:
    """Abnormal returns around events (id, secid, day): the first trading day at or after the
    event, mean and sample deviation of up to `estimation` returns before it, abnormal
    returns of the days -1, 0 and 1, their sum, volume against its mean, significance and
    confidence. All from windows over the price series; events meet it in an as-of join.
    """
    w = Window.partitionBy("secid").orderBy("day")
    before = w.rowsBetween(-estimation, -1)
    r = returns(prices)
    s = r.select(
        "secid", "day", "ret", F.count("ret").over(before).alias("n"), F.avg("ret").over(before).alias("mean"), F.stddev_samp("ret").over(before).alias("sigma"),
        F.lag("ret").over(w).alias("ret_before"), F.lead("ret").over(w).alias("ret_after"), (F.col("volume") / F.nullif(F.avg("volume").over(before), F.lit(0.0))).alias("spike"),
    )
    row = F.struct("day", "ret", "n", "mean", "sigma", "ret_before", "ret_after", "spike")
    s = s.select("secid", F.col("day").alias("trading_day"), row.alias("s"))
    hit = asof_join(events, s, ["secid"], "day", "trading_day", ["s"], forward=True).filter(F.col("s.n") >= least)
    abnormal = F.col("s.ret") - F.col("s.mean")
    out = hit.select(
        "id", "secid", F.col("s.day").alias("trading_day"), F.col("s.n").cast("long").alias("n"), abnormal.alias("ar"), F.col("s.sigma").alias("sigma"),
        (F.coalesce(F.col("s.ret_before") - F.col("s.mean"), F.lit(0.0)) + abnormal + F.coalesce(F.col("s.ret_after") - F.col("s.mean"), F.lit(0.0))).alias("car"),
        F.col("s.spike").alias("spike"),
    )
    significant = (F.abs("ar") > 2 * F.col("sigma")) | (F.coalesce("spike", F.lit(0.0)) > 2)
    z = F.abs("ar") / F.nullif(F.col("sigma"), F.lit(0.0))
    out = out.withColumn("significant", F.coalesce(significant, F.lit(False)))
    return out.withColumn("confidence", F.coalesce(S.market_confidence(z, F.col("significant")), F.lit(0.0))).withColumn("score", S.impact_score(F.col("ar"), F.col("sigma")))


def company_profile(companies: DataFrame, prices: DataFrame, shares: DataFrame) -> DataFrame:
    """Companies with their last price and capitalisation; null without a price or shares."""
    s = shares.groupBy(F.col("secid").alias("_s")).agg(F.max("shares").alias("shares"))
    out = companies.join(last_price(prices).select(F.col("secid").alias("_p"), "close"), F.col("secid") == F.col("_p"), "left").join(s, F.col("secid") == F.col("_s"), "left")
    return out.withColumn("cap", F.col("close") * F.col("shares")).drop("_p", "_s")
