"""Joins that the planner has no operator for, as rewrites to equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def interval_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, lo: int, hi: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs with lo <= right_ts - left_ts <= hi seconds, and equal keys.

    Time is cut into cells as wide as the interval; a left row goes to the at most
    two cells its interval touches, a right row to its own, so the pairs come from a
    hash join on (keys, cell) and each pair comes once. The columns of the two sides
    must differ but for the keys.
    """
    keys = keys or []
    width = max(hi - lo, 1) * MICROS
    lt, rt = F.unix_micros(left_ts), F.unix_micros(right_ts)
    cell = lambda t: F.floor(t / F.lit(width)).cast("long")
    r = right.withColumn("_cell", cell(rt)).select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys], "_cell")
    cells = F.sequence(cell(lt + lo * MICROS), cell(lt + hi * MICROS))
    near = (rt - lt).between(lo * MICROS, hi * MICROS)
    r = r.withColumnRenamed("_cell", "_r_cell")
    on = near & (F.col("_cell") == F.col("_r_cell"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    pairs = left.withColumn("_cell", F.explode(cells)).join(r, on)
    return pairs.drop("_cell", "_r_cell", *[f"_r_{k}" for k in keys])


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], tolerance: int | None = None, forward: bool = False
) -> DataFrame:
    """left with the `values` of the latest right row at or before its time (or, forward,
    the earliest at or after); null where none lies within `tolerance` seconds.

    Both sides are merged and one window carries the values over: a sort per key, no
    pairs. With a tolerance the windows go by (keys, cell of time) and right rows are
    lent to the next cell, so a hot key is dealt over its cells. Of right rows of one
    key and time the largest values count.
    """
    v = F.struct(F.col(right_ts).alias("t"), *[F.col(c).alias(c) for c in values])
    r = right.groupBy(*keys, right_ts).agg(F.max(v).alias("_v"))
    by = list(keys)
    if tolerance is not None:
        by.append("_cell")
        cell = lambda t: F.floor(F.unix_micros(F.col(t).cast("timestamp")) / F.lit(max(tolerance, 1) * MICROS)).cast("long")
        other = cell(right_ts) + (-1 if forward else 1)
        r = r.withColumn("_cell", F.explode(F.array(cell(right_ts), other)))
        left = left.withColumn("_cell", cell(left_ts))
    r = r.select(*by, F.col(right_ts).alias("_t"), F.lit(1 if forward else 0).alias("_side"), "_v", F.lit(None).alias("_row"))
    row = F.struct(*[F.col(c) for c in left.columns if c != "_cell"])
    lf = left.select(*by, F.col(left_ts).alias("_t"), F.lit(0 if forward else 1).alias("_side"), F.lit(None).alias("_v"), row.alias("_row"))
    merged = r.unionByName(lf)
    order = [F.col("_t").desc(), F.col("_side").desc()] if forward else [F.col("_t"), F.col("_side")]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = merged.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_row is not null")
    if tolerance is not None:
        gap = F.abs(F.unix_micros(F.col("_v.t").cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp")))
        got = got.withColumn("_v", F.when(gap <= tolerance * MICROS, F.col("_v")))
    return got.select("_row.*", F.col("_v.t").alias(f"{right_ts}_matched"), *[F.col(f"_v.{c}").alias(c) for c in values])


#: First words of a dictionary up to which they are looked for inside each row.
FIRST_WORDS = 1000


def ngram_join(texts: DataFrame, id_col: str, tokens: Column, dictionary: DataFrame, phrase: str, longest: int) -> DataFrame:
    """(id, columns of dictionary, first position): phrases of a dictionary that occur
    as whole tokens. N-grams of 1 to `longest` words meet the dictionary in one hash
    join, whatever its size; if its phrases start with at most FIRST_WORDS words, only
    the n-grams that start with one are made."""
    words = texts.select(F.col(id_col).alias("_id"), tokens.alias("_w"))
    heads = dictionary.select(F.split(phrase, " ")[0].alias("h")).distinct().limit(FIRST_WORDS + 1).collect()
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(1), F.size("_w"))).otherwise(F.array().cast("array<int>"))
    if len(heads) <= FIRST_WORDS:
        starts = F.filter(starts, lambda i: F.element_at("_w", i).isin([r.h for r in heads]))
    grams = F.flatten(
        F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_w") - i + 1)), lambda n: F.struct(F.array_join(F.slice("_w", i, n), " ").alias("g"), i.alias("i"))))
    )
    found = words.select("_id", F.explode(grams).alias("x")).select("_id", F.col("x.g").alias("_g"), F.col("x.i").alias("_i"))
    hit = found.join(dictionary, F.col("_g") == F.col(phrase))
    return hit.groupBy("_id", *dictionary.columns).agg(F.min("_i").alias("position")).withColumnRenamed("_id", id_col)


def near_window(df: DataFrame, keys: list[str], us: str, back: int, ahead: int, columns: dict) -> DataFrame:
    """df with window aggregates over the rows of the same keys within [us - back, us + ahead] microseconds.

    columns: name -> function of a window. Windows go by (keys, cell of time): a row
    is also lent to the neighbouring cells that its range can reach, so a key with a
    large share of all rows is worked on in as many tasks as there are cells. A negative
    `ahead` ends the range before the row.
    """
    width = max(back, ahead, 1)
    cell = F.floor(F.col(us) / F.lit(width)).cast("long")
    shifts = [0] + ([1] if back > 0 else []) + ([-1] if ahead > 0 else [])
    lent = df.withColumn("_shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumn("_cell", cell + F.col("_shift"))
    w = Window.partitionBy(*keys, "_cell").orderBy(us).rangeBetween(-back, ahead)
    for name, of in columns.items():
        lent = lent.withColumn(name, of(w))
    return lent.filter("_shift = 0").drop("_shift", "_cell")


def near_sums(df: DataFrame, keys: list[str], us: str, columns: dict[str, tuple[int, int, Column]]) -> DataFrame:
    """df with sums of whole numbers over the rows of the same keys in a range of time.

    columns: name -> (back, ahead, value): the sum of value over [us - back, us + ahead]
    microseconds; a negative bound ends the range before the row or begins it after. What
    near_window() gives, but a sliding frame is read anew for every row, so it costs the
    rows of a frame for each row. Here a row's value is added where ranges begin to hold
    it and taken off where they end to, and one running sum over both is read at the row:
    a few narrow rows for each row, however many a range has. Windows go by (keys, cell of
    time); what holds at the start of a cell is lent to it.
    """
    spans = list(dict.fromkeys((back, ahead) for back, ahead, _ in columns.values()))
    width = 2 * max(back + ahead + 1 for back, ahead in spans)
    t = F.col(us)
    cell = lambda x: F.floor(x / F.lit(width)).cast("long")
    zero = F.lit(0).cast("long")

    def mark(at: Column, when: Column, sign: int, own: set) -> Column:
        """Values of the ranges in `own`, and of no other; None in own: the row itself."""
        values = [(F.coalesce(v.cast("long"), zero) * sign if (b, a) in own else zero).alias(f"_v{i}") for i, (b, a, v) in enumerate(columns.values())]
        return F.struct(at.alias("_cell"), when.alias("_t"), F.lit(None in own).alias("_own"), *values)

    at_row = {s for s in spans if s[1] == 0}  # these begin to hold a row at its own time
    marks = [F.when(t.isNotNull(), mark(cell(t), t, 1, at_row | {None})).otherwise(mark(cell(t), t, 1, set(spans) | {None}))]
    for s in spans:
        back, ahead = s
        begin, end = t - ahead, t + back + 1
        if s not in at_row:
            marks.append(F.when(t.isNotNull(), mark(cell(begin), begin, 1, {s})))
        marks.append(F.when(t.isNotNull(), mark(cell(end), end, -1, {s})))
        marks.append(F.when(cell(begin) < cell(end), mark(cell(end), cell(end) * width, 1, {s})))
    dealt = df.withColumn("_m", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())))
    rest = [c for c in df.columns if c not in keys]
    dealt = dealt.select(*keys, "_m.*", *[F.when(F.col("_m._own"), F.col(c)).alias(c) for c in rest])
    w = Window.partitionBy(*keys, "_cell").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.withColumns({name: F.sum(f"_v{i}").over(w) for i, name in enumerate(columns)})
    return sums.filter("_own").select(*df.columns, *columns)
