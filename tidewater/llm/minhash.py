"""Near-duplicate groups by exact Jaccard similarity of word shingles.

1. signatures(): BANDS keys of each text, each a hash of ROWS MinHash values of its
   shingles. Two texts of similarity s share a band with probability
   1 - (1 - s^ROWS)^BANDS: 0.9998 at 0.8, more above.
2. links(): distinct texts that share a band are candidates. Their shingle sets are
   compared exactly in cells: buckets above `cell` members are dealt over cells of
   chunk pairs, so no task holds a hot bucket and no pair becomes a row. Of a cell
   only a spanning forest of the pairs that reach `least` leaves the task.
3. simhash.components() joins the links.

Defined results: words are split at ASCII white space and compared without the case
of ASCII letters; fewer words than a shingle make one shingle of all words; texts
without words are alike, null too; repeated rows are kept by near_duplicates(), each
with its component; a component of null ids only has a null id; only the id and the
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bit_map, map_arrow, probe, stored, text_chunks
from tidewater.llm.simhash import components, fingerprint, keep_first
from tidewater.llm.simhash import links as fingerprints_within

#: Bands of a signature and MinHash values in each.
BANDS = 28
ROWS = 6
#: Members of a bucket that are compared in one cell, per side.
CELL = 256
_RNG = np.random.default_rng(42)
_FACTOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    w = text.lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.frombuffer(b"".join(map(partial(xxhash.xxh64_digest, seed=seed), parts)), ">u8").astype(np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """Band keys as signed 64-bit integers; a text without words has keys of its own."""
    least = np.full(len(_FACTOR), ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 10):
        least = np.minimum(least, (hashes[at : at + (1 << 10), None] * _FACTOR + _SHIFT).min(axis=0))
    raw = least.astype("<u8").tobytes()
    step = 8 * ROWS
    return [int(np.uint64(xxhash.xxh64_intdigest(raw[i * step : (i + 1) * step])).view(np.int64)) for i in range(BANDS)]


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, simhash: bool = False) -> DataFrame:
    """(id, digest, bands), one row per row of docs; with `simhash` also `fp`, as of simhash.fingerprints()."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            out = {"id": part.column("id"), "digest": part.column("digest"), "bands": pa.array([bands(shingles(t, words)) for t in texts], pa.list_(pa.int64()))}
            if simhash:
                out["fp"] = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    slim = docs.select(F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return map_arrow(slim, run, f"id {kind}, digest string, bands array<long>" + ", fp long" * simhash)


def cell_links(sets: list[np.ndarray], nodes: np.ndarray, sides: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one cell whose similarity reaches `least`.

    In a cell of two chunks (sides 0 and 1) only pairs across are compared.
    """
    size = np.array([len(s) for s in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(sets)), size)
    two = sides.max() == 1
    mark = np.zeros(len(place) + 1, bool)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(sets)):
        if two and sides[i]:
            continue
        own = place[starts[i] : starts[i + 1]]
        mark[own] = True
        shared = np.bincount(owner[mark[place]], minlength=len(sets))
        mark[own] = False
        # in hundred-thousandths, so that a similarity of exactly `least` counts on every machine
        near = shared * 100_000 >= round(least * 100_000) * (size + size[i] - shared)
        near &= (sides == 1) if two else (np.arange(len(sets)) > i)
        for j in np.flatnonzero(near):
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def links(classes: DataFrame, docs: DataFrame, text_col: str = "text", words: int = 5, least: float = 0.8, cell: int = CELL) -> DataFrame:
    """(a, b): edges whose components are those of all candidates with a similarity of `least`.

    classes: a stored table (node, digest, bands) of the distinct texts of docs.
    """
    keyed = classes.select("node", F.posexplode("bands").alias("t", "k"))
    crowded = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(keyed.join(crowded, ["t", "k"]), "members")
    needed = stored(members.select("node").distinct().join(classes.select("node", "digest"), "node"), "needed")
    seen = probe(docs.select(_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text")), "digest", bit_map(needed, "digest"))
    once = seen.filter("_may").groupBy("digest").agg(F.first("text").alias("text"))
    texts = stored(once.join(needed, "digest").select("node", "text"), "texts")
    cells = (
        members.withColumn("parts", F.ceil(F.col("n") / cell).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("node", "t", "k", F.least("mine", "other").alias("c1"), F.greatest("mine", "other").alias("c2"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    )
    place = ["t", "k", "c1", "c2"]
    cells = cells.join(texts, "node").repartition(*place).sortWithinPartitions(*place).select(*place, "side", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, nodes, sides = None, [], [], []  # a cell may go on in the next batch

        def flush() -> pa.RecordBatch:
            found = cell_links(sets, np.array(nodes), np.array(sides), least) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for row, text in zip(zip(*columns, strict=True), batch.column("text").cast(pa.binary()), strict=True):
                if row[:4] != at:
                    if sets:
                        yield flush()
                    at, sets, nodes, sides = row[:4], [], [], []
                own = shingles(text.as_py(), words)
                sets.append(own if len(own) else np.zeros(1, np.uint64))  # no words: alike
                sides.append(row[4])
                nodes.append(row[5])
        if sets:
            yield flush()

    return map_arrow(cells, run, "a long, b long")


def fingerprint_links(classes: DataFrame, radius: int) -> DataFrame:
    """(a, b): edges between nodes of classes (node, fp) whose components are those of the SimHash links."""
    first = stored(classes.groupBy("fp").agg(F.min("node").alias("first")), "distinct")
    equal = classes.join(first, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    node = lambda end: first.select(F.col("fp").alias(end), F.col("first").alias(f"_{end}"))
    near = fingerprints_within(first.select("fp"), radius).join(node("a"), "a").join(node("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return equal.unionByName(near)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, radius: int | None = None) -> DataFrame:
    """(id, component): every row of docs with the smallest id that it is linked to.

    With a radius the SimHash links of op5, fingerprints within so many bits, count too."""
    rows = stored(signatures(docs, id_col, text_col, words, radius is not None), "signatures")
    found = [F.min("id").alias("least"), F.first("bands").alias("bands")] + ([F.first("fp").alias("fp")] if radius is not None else [])
    classes = stored(rows.groupBy("digest").agg(*found).withColumn("node", F.monotonically_increasing_id()), "classes")
    edges = links(classes, docs, text_col, words, least)
    if radius is not None:
        edges = edges.unionByName(fingerprint_links(classes, radius))
    roots = components(edges).withColumnRenamed("root", "_root")
    rooted = classes.select("digest", "least", F.col("node").alias("own")).join(roots, F.col("own") == F.col("node"), "left")
    rooted = rooted.select("digest", "least", F.coalesce("_root", "own").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(of_root, "root").select("digest", "component")
    return rows.select("id", "digest").join(named, "digest").select(F.col("id").alias(id_col), "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, radius: int | None = None) -> DataFrame:
    """The rows of docs, all columns, whose id is the smallest of its component, as simhash.keep_first() says."""
    return keep_first(docs, near_duplicates(docs, id_col, text_col, words, least, radius), id_col, text_col)
