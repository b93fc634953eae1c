"""Watch rules, predictions and their fulfilment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import scores as S
from tidewater.operators.analytics import top_per_key
from tidewater.plans import dims
from tidewater.plans.joins import asof_join, near_sums


def rules_table(spark, level: str | None = None, rules=None) -> DataFrame:
    rows = [r for r in (rules or dims.WATCH_RULES) if level in (None, r[1])]
    return spark.createDataFrame(rows, "rule_id string, level string, types array<string>, companies array<string>, sectors array<string>, importance double, burst int, days int")


def _listed(wanted: Column, have: Column) -> Column:
    """An empty list takes everything."""
    return (F.size(wanted) == 0) | F.coalesce(F.arrays_overlap(wanted, have), F.lit(False))


def counted(events: DataFrame, rules: DataFrame, hours: int = 24) -> DataFrame:
    """Events of the types that rules name, with `n24`, the events of the type in the hours up to each."""
    types = rules.select(F.explode("types").alias("_type")).distinct()
    asked = events.join(F.broadcast(types), F.col("event_type") == F.col("_type"), "left_semi")
    return near_sums(asked, ["event_type"], "us", {"n24": (hours * 3_600_000_000, 0, F.lit(1))})


def watches(events: DataFrame, rules: DataFrame, ask_burst: bool = True, ask_sectors: bool = True) -> DataFrame:
    """(rule_id, level, event_id, triggered, expires): events (id, us, event_type, importance,
    n24, companies, sectors) that meet a rule; each pair once. Events meet rules by type."""
    r = rules.withColumn("_type", F.explode("types"))
    j = events.join(F.broadcast(r.select("rule_id", "level", "_type", F.col("companies").alias("rc"), F.col("sectors").alias("rs"), F.col("importance").alias("least"), F.col("burst").alias("least_n"), "days")), F.col("event_type") == F.col("_type"))
    ok = _listed(F.col("rc"), F.col("companies")) & (F.col("importance") >= F.col("least"))
    if ask_sectors:
        ok = ok & _listed(F.col("rs"), F.col("sectors"))
    if ask_burst:
        ok = ok & (F.col("n24") >= F.col("least_n"))
    return j.filter(ok).select("rule_id", "level", F.col("id").alias("event_id"), F.col("us").alias("triggered"), (F.col("us") + F.col("days") * 86_400_000_000).alias("expires")).dropDuplicates(["rule_id", "event_id"])


def chain_watches(found: DataFrame, paths: DataFrame, importance: DataFrame, least: float = 0.5, k: int = 5) -> DataFrame:
    """L2: watches whose event causes an important one over paths (start, target, depth,
    confidence), the k most important targets of each."""
    imp = importance.select(F.col("event_id").alias("target"), F.col("importance_score").alias("target_importance"))
    j = found.join(paths, F.col("event_id") == F.col("start")).join(imp, "target").filter(F.col("target_importance") >= least)
    return top_per_key(j, ["rule_id", "event_id"], [F.col("target_importance").desc(), F.col("target")], k)


def predictions(found: DataFrame, spark, family: str = "follow_up_events") -> DataFrame:
    """(rule_id, event_id, predicted_type, probability, days, due) from watches with columns
    event_type, importance, price_impact, connections. The type matches if it contains the pattern."""
    odds, days = dims.PREDICTION_ODDS[family]
    rows = [(src, t, odds[i], days[i], i + 1) for f, src, types in dims.PREDICTIONS if f == family for i, t in enumerate(types)]
    table = F.broadcast(spark.createDataFrame(rows, "pattern string, predicted_type string, base double, days int, place int"))
    j = found.join(table, F.col("event_type") == F.col("pattern"))
    p = S.prediction_probability(F.col("base"), F.col("importance"), F.col("price_impact"), F.col("predicted_type").rlike("market|volatility"), F.col("connections"))
    return j.select("rule_id", "event_id", "predicted_type", F.round(p + 1e-9, 6).alias("probability"), "days", (F.col("triggered") + F.col("days") * 86_400_000_000).alias("due"))


CATEGORIES = {
    "sanctions": "sanctions", "rate": "rate", "earnings": "earnings", "market": "market", "regulatory": "regulatory", "dividend": "dividend", "merger": "merger", "volatility": "volatility",
}


def type_matches(predicted: Column, actual: Column) -> Column:
    """Equal, or a part of the predicted type (between underscores) that names a category occurs in the actual type."""
    keys = F.array(*[F.lit(k) for k in CATEGORIES])
    return (predicted == actual) | F.exists(F.split(predicted, "_"), lambda t: F.array_contains(keys, t) & actual.contains(t))


def fulfilled(made: DataFrame, events: DataFrame, widest_days: int = 30) -> DataFrame:
    """Predictions (prediction_id, predicted_type, from_ts, due_ts) with the first event
    that fulfils them; null ids where none does.

    Which types match is worked out once over the distinct types; then every matching
    type needs one forward as-of join, and no event is paired with all predictions.
    """
    kinds = events.select(F.col("event_type").alias("actual_type")).distinct()
    match = made.select("predicted_type").distinct().join(F.broadcast(kinds), type_matches(F.col("predicted_type"), F.col("actual_type")))
    asked = made.select("prediction_id", "predicted_type", "from_ts", "due_ts").join(F.broadcast(match), "predicted_type")
    e = events.select(F.col("event_type").alias("actual_type"), F.col("ts").alias("actual_ts"), (-F.col("id")).alias("minus_id"))
    hit = asof_join(asked, e, ["actual_type"], "from_ts", "actual_ts", ["minus_id"], tolerance=widest_days * 86400, forward=True)
    hit = hit.filter(F.col("actual_ts_matched") <= F.col("due_ts"))
    first = hit.groupBy("prediction_id").agg(F.min(F.struct(F.col("actual_ts_matched").alias("actual_ts"), (-F.col("minus_id")).alias("actual_id"))).alias("f"))
    return made.join(first, "prediction_id", "left").select(*made.columns, F.col("f.actual_id").alias("actual_event_id"), F.col("f.actual_ts").alias("fulfilled_at"))


def prediction_status(rows: DataFrame, now: Column) -> DataFrame:
    """fulfilled, pending, or expired past the due time."""
    return rows.withColumn("status", F.when(F.col("actual_event_id").isNotNull(), "fulfilled").when(F.col("due_ts") < now, "expired").otherwise("pending"))


def accuracy(rows: DataFrame) -> DataFrame:
    """By predicted type with any fulfilment: fulfilled, open and their share."""
    g = rows.groupBy("predicted_type").agg(F.count_if(F.col("status") == "fulfilled").alias("hits"), F.count_if(F.col("status") == "pending").alias("open"))
    return g.filter("hits > 0").withColumn("accuracy", F.round(F.col("hits") / (F.col("hits") + F.col("open")), 6))
