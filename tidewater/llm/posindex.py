"""Benchmark decontamination with a distributed positional inverted index.

Everything here is DataFrame operations: no Python runs on the executors.

build() stores one posting (term_id, key, id, pos) for each token of the training
documents whose term is in the vocabulary of the test items; postings of other
terms could never be read. The index is partitioned by document and written to
the shared folder. Term 0, the empty term, is posted before the first and after
the last word, so the index also knows every document's length.

phrases() orders the terms of each window of test words by their number of
postings and intersects offset-adjusted lists from the rarest: the postings of the
rarest term, shifted by its place in the item, give diagonals (document, item,
shift); the second rarest term must lie on the same diagonal. What is left is
checked term by term against the stored postings; a bit map of fixed size keeps
the postings of other documents out of that join. proximity() looks for the
rarest terms of an item within a span instead.

Terms are numbered without gaps, so two words are one term only if they are equal.
The vocabulary is broadcast up to BROADCAST_TERMS distinct terms; beyond that a bit map
of fixed size drops tokens that certainly aren't in it and the rest is joined by
shuffles, each term dealt over several tasks. The tables made of the test items are
broadcast up to as many words of test text; beyond that the same joins are shuffled.
Both are counted first.

Defined results: a null or empty text has no words; an item without words matches
nothing; a test table without rows gives no hits; repeated documents are judged
row by row; repeated item ids count once. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import bit_map, probe, ranked, salted_join, stored, without

#: What separates words, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters outside ASCII that lower() changes.
WIDE_CAPITALS = r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct terms, and words, of test items up to which tables made of them are broadcast.
BROADCAST_TERMS = 1 << 18


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept; translate() only where lower() would change more."""
    return F.when(text.rlike(WIDE_CAPITALS), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def tokens(text: Column) -> Column:
    """An empty term, the words, and an empty term."""
    return F.split(F.concat(F.lit("."), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(".")), SEPARATORS)


@dataclass
class Index:
    """Stored postings and what belongs to them; small: tables made of the items may be broadcast."""

    postings: DataFrame
    vocabulary: DataFrame
    items: DataFrame  # item, item_id, n, ipos, term, term_id, df: the number of the term's postings
    small: bool

    def side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, n, ipos, term): the words of test items; `item` names a distinct row."""
    words = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    words = words.select(F.monotonically_increasing_id().alias("item"), "item_id", tokens(F.col("text")).alias("w"))
    words = words.withColumn("n", F.size("w") - 2)
    return words.select("item", "item_id", "n", F.posexplode(F.slice("w", F.lit(2), F.greatest("n", F.lit(0)))).alias("ipos", "term"))


def build(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> Index:
    """Post the documents' tokens that occur in any test item."""
    words = stored(item_words(items, item_id, item_text), "items")
    terms = words.select("term").distinct().withColumn("one", F.lit(0))
    terms = ranked(terms, ["one"], F.pmod(F.xxhash64("term"), F.lit(256)), [F.col("term")], "rank").select("term", (F.col("rank") + 1).alias("term_id"))
    empty = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).cast("long").alias("term_id"))
    vocabulary = stored(terms.unionByName(empty), "vocabulary")
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    found = keyed.select("key", "id", F.posexplode("w").alias("pos", "term"))
    if vocabulary.count() <= BROADCAST_TERMS:
        known = found.join(F.broadcast(vocabulary), "term")
    else:
        known = probe(found, "term", bit_map(vocabulary, "term")).filter("_may").drop("_may")
        known = salted_join(known, vocabulary, "term", F.struct("key", "pos"))
    postings = stored(known.select("term_id", "key", "id", "pos"), "postings")
    counts = postings.filter("term_id <> 0").groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
    words = words.join(vocabulary, "term").join(counts, "term_id", "left").fillna(0, ["df"])
    small = (words := stored(words, "words")).count() <= BROADCAST_TERMS
    return Index(postings, vocabulary, words, small)


def phrases(index: Index, window: int = 10) -> DataFrame:
    """(key, id, item_id, start, stop): maximal runs of document words, 0-based and
    inclusive, that agree word by word with an item over `window` words or more, or
    over a whole item of fewer words."""
    words = index.items
    length = F.least(F.col("n"), F.lit(window))
    first = F.greatest(F.col("ipos") - length + 1, F.lit(0))
    last = F.least(F.col("ipos"), F.col("n") - length)
    windows = words.select("item", F.explode(F.sequence(first, last)).alias("w"), F.struct("df", "term_id", "ipos").alias("x"))
    plans = windows.groupBy("item", "w").agg(F.slice(F.array_sort(F.collect_list("x")), 1, 2).alias("rarest"))
    plans = plans.filter("rarest[0].df > 0").select(
        "item", F.expr("rarest[0].ipos").alias("i1"), F.expr("coalesce(get(rarest, 1).ipos, rarest[0].ipos)").alias("i2")
    ).distinct()
    plans = stored(plans, "plans")
    terms = words.select("item", "ipos", "term_id")

    def diagonals(anchor: str) -> DataFrame:
        """The postings of these anchors, less their place in the item."""
        of = plans.select("item", F.col(anchor).alias("ipos")).distinct().join(terms, ["item", "ipos"])
        return index.postings.join(index.side(of), "term_id").select("key", "item", (F.col("pos") - 1 - F.col("ipos")).alias("shift"), F.col("ipos").alias(anchor))

    wanted = diagonals("i1").join(index.side(plans), ["item", "i1"]).select("key", "item", "shift", "i2")
    seeds = wanted.join(diagonals("i2"), ["key", "item", "shift", "i2"], "left_semi").select("key", "item", "shift").distinct()
    seeds = stored(seeds, "seeds")
    expected = seeds.join(index.side(words.select("item", "item_id", "n", "ipos", "term_id")), "item").select(
        "key", "item", "item_id", "n", "shift", "ipos", "term_id", (F.col("shift") + F.col("ipos") + 1).alias("pos")
    )
    near = probe(index.postings.filter("term_id <> 0"), "key", bit_map(seeds.select("key"), "key")).filter("_may").drop("_may")
    hits = expected.join(near, ["key", "pos", "term_id"])
    diagonal = Window.partitionBy("key", "item", "shift").orderBy("ipos")
    runs = hits.withColumn("island", F.col("ipos") - F.row_number().over(diagonal))
    runs = runs.groupBy("key", "id", "item", "item_id", "n", "shift", "island").agg(F.min("ipos").alias("a"), F.max("ipos").alias("b"))
    return runs.filter(F.col("b") - F.col("a") + 1 >= length).select(
        "key", "id", "item_id", (F.col("shift") + F.col("a")).alias("start"), (F.col("shift") + F.col("b")).alias("stop")
    )


def proximity(index: Index, span: int = 20, terms: int = 3) -> DataFrame:
    """(key, id, item_id, pos): places of an item's rarest term that have its next
    rarest terms, `terms` in all, within `span` positions on either side. Terms that no
    document has don't count; equally rare ones go by the term. Items with fewer
    distinct terms use what they have."""
    order = Window.partitionBy("item").orderBy("df", "term")
    distinct = index.items.filter("df > 0").select("item", "item_id", "term_id", "term", "df").distinct()
    chosen = distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= terms)
    chosen = chosen.withColumn("wanted", F.count(F.lit(1)).over(Window.partitionBy("item")))
    lists = index.postings.join(index.side(chosen), "term_id").select("key", "id", "item", "item_id", "rank", "wanted", "pos")
    lists = stored(lists.withColumn("cell", F.floor(F.col("pos") / span)), "lists")
    anchors = lists.filter("rank = 1").withColumn("near", F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])))
    others = lists.select(F.col("key").alias("k"), F.col("item").alias("i"), F.col("cell").alias("c"), F.col("pos").alias("p"), F.col("rank").alias("r"))
    on = (F.col("key") == F.col("k")) & (F.col("item") == F.col("i")) & (F.col("near") == F.col("c")) & (F.abs(F.col("pos") - F.col("p")) <= span)
    met = anchors.join(others, on).groupBy("key", "id", "item", "item_id", "pos", "wanted").agg(F.countDistinct("r").alias("got"))
    return met.filter("got = wanted").select("key", "id", "item_id", (F.col("pos") - 1).alias("pos"))


def contamination(index: Index, window: int = 10, id_col: str = "doc_id") -> DataFrame:
    """One row for each document row: its words, the words inside phrases, and the items
    found; the places where an item's rarest words are near each other, and those items."""
    runs = stored(phrases(index, window), "runs")
    hit = runs.select("key", F.explode(F.sequence("start", "stop")).alias("pos")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    found = runs.groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    near = proximity(index).groupBy("key").agg(F.count(F.lit(1)).alias("n_near"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("near_items"))
    lengths = index.postings.filter("term_id = 0").groupBy("key", "id").agg((F.max("pos") - 1).alias("n_words"))
    return lengths.join(hit, "key", "left").join(found, "key", "left").join(near, "key", "left").select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without a phrase of an item. Rows are told apart by 128 bits of
    hashes of id and text, so a row doesn't go for another one with its id."""
    row = F.struct(*[F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias(f"h{seed}") for seed in (1, 2)])
    named = docs.withColumn("_row", row)
    bad = stored(phrases(build(named, items, "_row", text_col), window).select("id").distinct(), "contaminated")
    return without(named, "_row", bad).drop("_row")
