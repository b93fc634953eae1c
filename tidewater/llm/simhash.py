"""SimHash near-duplicate groups by bit-sliced comparison.

1. fingerprints(): one 64-bit SimHash of the word shingles of each text.
2. links(): distinct fingerprints are cut into radius + 2 blocks. Two that differ
   in at most `radius` bits agree in two blocks at least, so every link lies in a
   bucket of some pair of blocks. A bucket is compared bit-sliced: bit plane p
   holds bit p of 64 fingerprints in one machine word; a query's bit is XORed into
   a plane, the differences go through carry-save counters, and a word is left as
   soon as all its fingerprints exceed the radius. Buckets above `cell` members
   are dealt over cells of chunk pairs, so no task holds a hot bucket.
3. components(): connected components of the links by alternating large-star and
   small-star joins; each round is written to the shared folder.

Of a cell only a spanning forest of its links leaves the task: no pairs are
expanded and no link between different fingerprints is lost.

Defined results: a null or empty text, or one without words, has fingerprint zero
and is linked like any other; fewer words than a shingle make one shingle of all
words; repeated rows are kept, each with its component; a component of null ids
only has a null id; only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import drop_stored, map_arrow, stored, text_chunks, without

#: Members of a bucket that are compared in one cell, per side.
CELL = 4096
#: (query, word) lanes that are compared together.
LANES = 1 << 16
#: Bit planes after which lanes that exceed the radius are left.
STRIDE = 8


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles, as an unsigned 64-bit integer."""
    w = text.lower().split() if text else []
    if not w:
        return 0
    digest = partial(xxhash.xxh64_digest, seed=seed)
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.frombuffer(b"".join(map(digest, shingles)), np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42
) -> DataFrame:
    """(id, fp long): the fingerprint as a signed 64-bit integer, one row per row of docs."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            raw = part.column("text").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, words, seed) for t in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp)], ["id", "fp"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)


def blocks_of(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of the radius + 2 blocks of a fingerprint."""
    edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def close_pairs(
    fps: np.ndarray, lanes_q: np.ndarray, lanes_w: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int, order: list[int]
) -> tuple[np.ndarray, np.ndarray]:
    """Lanes (query index, word index) against their words: (lane, mask of members within the radius)."""
    lane = np.arange(len(lanes_q))
    q, w = fps[lanes_q], lanes_w
    digits = max(1, radius.bit_length())
    counters = np.zeros((digits, len(lane)), np.uint64)
    over = ~valid[w]
    full = ~np.uint64(0)

    def exceeded() -> np.ndarray:
        """Members whose counter is above the radius, or that overflowed it."""
        above, equal = np.zeros_like(over), np.full_like(over, full)
        for k in reversed(range(digits)):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                above |= equal & counters[k]
                equal &= ~counters[k]
        return over | above

    for step, p in enumerate(order):
        bit = (q >> np.uint64(p)) & np.uint64(1)
        carry = planes[p][w] ^ (np.uint64(0) - bit)
        for k in range(digits):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if step % STRIDE == STRIDE - 1:
            alive = np.flatnonzero(exceeded() != full)
            if len(alive) < len(lane):
                lane, q, w, over, counters = lane[alive], q[alive], w[alive], over[alive], counters[:, alive]
                if not len(lane):
                    break
    near = ~exceeded()
    hit = np.flatnonzero(near)
    return lane[hit], near[hit]


def cell_links(fps: np.ndarray, starts: np.ndarray, sides: np.ndarray, radius: int, order: list[int]) -> list[tuple[int, int]]:
    """Spanning forests of the links in consecutive cells.

    fps: members, cell by cell; starts: where each cell begins, and the end;
    sides: 0, or 1 for the second chunk of a cell of two, whose members are
    compared with those of the first alone.
    """
    sizes = np.diff(starts)
    words = (sizes + 63) // 64
    word_at = np.concatenate([[0], np.cumsum(words)])
    cell = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(fps)) - starts[cell]
    slot = (word_at[cell] + inside // 64) * 64 + inside % 64
    member = np.full(int(word_at[-1]) * 64, -1, np.int64)
    member[slot] = np.arange(len(fps))
    two = np.maximum.reduceat(sides, starts[:-1])[cell] == 1  # the cell has two chunks

    def packed(bits: np.ndarray) -> np.ndarray:
        lanes = np.zeros(len(member), bool)
        lanes[slot] = bits
        return np.packbits(lanes.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)

    planes = {p: packed((fps >> np.uint64(p)) & np.uint64(1) == 1) for p in order}
    valid = packed(~two | (sides == 1))
    parent = np.arange(len(fps))
    queries = np.flatnonzero(~two | (sides == 0))
    per = words[cell[queries]]
    for a, b in _slices(per, LANES):
        n = per[a:b]
        who = np.repeat(queries[a:b], n)
        word = word_at[cell[who]] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        lane, near = close_pairs(fps, who, word, planes, valid, radius, order)
        bits = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.nonzero(bits)
        _unite(parent, who[lane[i]], member[word[lane[i]] * 64 + j])
    root = _find(parent, np.arange(len(fps)))
    return [(int(x), int(y)) for x, y in zip(fps[root != np.arange(len(fps))].view(np.int64), fps[root[root != np.arange(len(fps))]].view(np.int64), strict=True)]


def _slices(weights: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    total = np.cumsum(weights)
    a = 0
    while a < len(weights):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = parent[up]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def links(distinct: DataFrame, radius: int = 2, cell: int = CELL) -> DataFrame:
    """(a, b): edges whose components are those of all links within the radius.

    distinct: a table with the column fp, each value once.
    """
    blocks = blocks_of(radius)
    tables = list(combinations(range(len(blocks)), 2))

    def key(pair: tuple[int, int]):
        parts = [F.shiftrightunsigned(F.col("fp"), blocks[i][0]).bitwiseAND((1 << blocks[i][1]) - 1) for i in pair]
        return F.shiftleft(parts[0], blocks[pair[1]][1]).bitwiseOR(parts[1])

    keyed = distinct.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), key(p).alias("k")) for t, p in enumerate(tables)])).alias("x"),
    ).select("fp", "x.t", "x.k")
    crowded = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / cell).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = (
        keyed.join(crowded, ["t", "k"])
        .withColumn("parts", parts)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "t", "k", F.least("mine", "other").alias("c1"), F.greatest("mine", "other").alias("c2"),
            (F.col("mine") > F.col("other")).cast("int").alias("side"), "fp",
        )
    )
    cells = cells.repartition("t", "k", "c1", "c2").sortWithinPartitions("t", "k", "c1", "c2")
    order = [
        [p for i, (a, n) in enumerate(blocks) if i not in pair for p in range(a, a + n)] for pair in tables
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last cell of a batch may go on in the next

        def flush(rows: list[np.ndarray]) -> pa.RecordBatch:
            t, k, c1, c2, side, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
            new = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0) | (np.diff(c1) != 0) | (np.diff(c2) != 0)) + 1
            starts = np.concatenate([[0], new, [len(t)]])
            out: list[tuple[int, int]] = []
            for table in np.unique(t[starts[:-1]]):
                of = np.flatnonzero(t[starts[:-1]] == table)
                of = of[starts[of + 1] - starts[of] > 1]
                if len(of):
                    at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in of])
                    ends = np.concatenate([[0], np.cumsum(starts[of + 1] - starts[of])])
                    out += cell_links(fp[at].view(np.uint64), ends, side[at], radius, order[table])
            a, b = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append(rows)
            ids = list(zip(*[r[[0, -1]].tolist() for r in rows[:4]], strict=True))
            if ids[0] != ids[1]:
                last = np.flatnonzero(np.any([np.diff(r) != 0 for r in rows[:4]], axis=0))[-1] + 1
                held[-1] = [r[:last] for r in rows]
                yield flush(held)
                held = [[r[last:] for r in rows]]
        if held:
            yield flush(held)

    return map_arrow(cells, run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b), for nodes that have an edge.

    The root is the smallest node. Only counts reach the driver.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last, edges = edges, stored(small.filter("a <> b").distinct(), "links")
        drop_stored(last)
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(seen)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42
) -> DataFrame:
    """(id, fp, component): every row of docs with the smallest id that it is linked to."""
    rows = stored(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    smallest = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(smallest.select("fp"), radius))
    rooted = smallest.join(roots, smallest["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = rooted.join(of_root, "root").select("fp", "component")
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component")


def keep_first(docs: DataFrame, near: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose id is the smallest of its component in near (id, component).

    Of rows with the same id and the same text one stays; they are looked for only
    if a kept id occurs twice.
    """
    own = F.col(id_col).eqNullSafe(F.col("component"))
    ids = stored(near.groupBy(F.col(id_col).alias("_id")).agg(F.bool_or(own).alias("_kept"), F.count(F.lit(1)).alias("_rows")), "ids")
    out = without(docs, id_col, ids.filter("not _kept").select("_id"))
    if ids.filter("_kept and _rows > 1").limit(1).count():
        out = out.withColumn("_same", F.sha2(F.col(text_col).cast("binary"), 256)).dropDuplicates([id_col, "_same"]).drop("_same")
    return out


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42
) -> DataFrame:
    """keep_first() of the components of near_duplicates()."""
    return keep_first(docs, near_duplicates(docs, id_col, text_col, words, radius, seed), id_col, text_col)
