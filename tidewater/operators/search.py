"""Retrieval: chunks, BM25, vectors, fusion, re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import scores as S
from tidewater.functions import text as T
from tidewater.operators.analytics import top_per_key
from tidewater.session import stored


def chunks(docs: DataFrame, id_col: str, text: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """(parent, chunk_index, chunk_id, chunk): stride chunks of every text."""
    c = docs.select(F.col(id_col).alias("parent"), F.posexplode(T.stride_chunks(F.col(text), size, overlap)).alias("chunk_index", "chunk"))
    return c.withColumn("chunk_id", F.concat_ws("-", F.col("parent").cast("string"), F.col("chunk_index").cast("string")))


def terms(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("([a-zà-öø-ÿ0-9]+)"), 1)


def _is(word: str) -> Callable[[Column], Column]:
    return lambda t: t == word


def bm25(docs: DataFrame, id_col: str, text: str, query: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents with a query term: idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    Term frequencies are counted inside each row and written once, a few numbers for
    each document; N, the mean length and the document frequencies are one row made from
    these, so texts are read and cut into words once."""
    q = list(dict.fromkeys(query))
    counted = docs.select(F.col(id_col).alias("id"), terms(F.col(text)).alias("w")).select(
        "id", F.size("w").alias("len"), *[F.size(F.filter("w", _is(w))).alias(f"tf{i}") for i, w in enumerate(q)]
    )
    counted = stored(counted, "terms")
    stats = counted.agg(F.count(F.lit(1)).alias("N"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(q))])
    j = counted.join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(q)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("N") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    hit = F.lit(False)
    for i in range(len(q)):
        hit = hit | (F.col(f"tf{i}") > 0)
    return j.filter(hit).select("id", score.alias("score"))


def nearest(vectors: DataFrame, id_col: str, vector: str, query: Sequence[float]) -> DataFrame:
    """(id, score): cosine with the query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), S.cosine(F.col(vector), q).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.round("score", 9).desc(), "id").limit(k)


def normalised(scored: DataFrame) -> DataFrame:
    """Scores from 0 to 1 by minimum and maximum; a constant list becomes 1. For top lists:
    the window over all rows reads the list once."""
    w = Window.partitionBy()
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    x = F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return scored.select("id", x.alias("score"))


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, alpha: float = 0.6, limit: int = 10) -> DataFrame:
    """Relative score fusion of two top lists: alpha x vector + (1 - alpha) x keyword."""
    v, w = normalised(vector_hits).withColumnRenamed("score", "v"), normalised(keyword_hits).withColumnRenamed("score", "w")
    j = v.join(w, "id", "full").select("id", (alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("w", F.lit(0.0))).alias("score"))
    return top(j, limit)


def overlap_rerank(query: Column, text: Column) -> Column:
    """Jaccard of the words of query and text: the built-in re-ranker."""
    return T.jaccard(T.word_set(query), T.word_set(text))


def hot_order(hits: DataFrame, weight: float = 0.3) -> DataFrame:
    """Positions by rerank_score, the final score with hotness, and positions by that. For result pages, not corpora."""
    h = hits.withColumn("final_score", S.blend(F.col("rerank_score"), F.col("hotness"), weight))
    h = h.withColumn("original_position", F.row_number().over(Window.orderBy(F.round("rerank_score", 9).desc(), "id")))
    return h.withColumn("final_position", F.row_number().over(Window.orderBy(F.round("final_score", 9).desc(), "id")))


def one_per_parent(hits: DataFrame, limit: int = 3) -> DataFrame:
    """The best chunk of each parent, the best parents first."""
    first = top_per_key(hits, ["parent"], [F.round("final_score", 9).desc(), F.col("id")], 1).drop("rank")
    return first.orderBy(F.round("final_score", 9).desc(), "id").limit(limit)


def search(
    found: DataFrame, text: str, query: str, vector_hits: DataFrame, alpha: float = 0.6, limit: int = 10, rerank: Callable[[Column, Column], Column] = overlap_rerank, weight: float = 0.3, documents: int = 3
) -> DataFrame:
    """End to end over chunks (id, parent, hotness, text): hybrid, re-rank, hotness, one chunk per document."""
    words = query.lower().split()
    hybrid = fuse(top(vector_hits, limit), top(bm25(found, "id", text, words), limit), alpha, limit).withColumnRenamed("score", "hybrid_score")
    hits = found.join(F.broadcast(hybrid), "id").withColumn("rerank_score", rerank(F.lit(query), F.col(text)))
    return one_per_parent(hot_order(hits, weight), documents)


def near_vectors(vectors: DataFrame, id_col: str, vector: str, block: str, least: float = 0.8) -> DataFrame:
    """(src, dst, similarity): pairs of one block whose cosine exceeds `least`. Vectors are
    scaled once; pairs meet by equi-join on the block."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.select(F.col(id_col).alias("id"), F.col(block).alias("b"), norm.alias("n"), vector).filter("n > 0").select("id", "b", F.transform(vector, lambda x: x.cast("double") / F.col("n")).alias("u"))
    a, c = unit.select(F.col("id").alias("src"), "b", F.col("u").alias("x")), unit.select(F.col("id").alias("dst"), "b", F.col("u").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return a.join(c, "b").filter("src < dst").select("src", "dst", dot.alias("similarity")).filter(F.col("similarity") > least)
