"""Property-graph operators over edge tables (src, dst, conf or rho)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators.analytics import top_per_key
from tidewater.session import ship_package, stored


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of undirected edges."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def neighbours(edges: DataFrame, node, least: float = 0.5, k: int = 10) -> DataFrame:
    """The most correlated neighbours of a node in undirected edges (src, dst, rho)."""
    rows = symmetric(edges).filter((F.col("src") == F.lit(node)) & (F.abs("rho") >= least))
    return rows.orderBy(F.abs("rho").desc(), "dst").limit(k)


def paths(edges: DataFrame, start: DataFrame, depth: int = 3, least: float = 0.3) -> DataFrame:
    """Paths of 1 to `depth` edges of confidence `least` or more from the nodes of start
    (column node), each edge used once: start, nodes, depth, confidence (the product).

    One join per step on the frontier's last node."""
    e = edges.filter(F.col("conf") >= least).select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("conf").alias("_c"))
    step = start.select(F.col("node").alias("start"), F.col("node").alias("last"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("used"), F.lit(1.0).alias("confidence"))
    out = None
    for d in range(1, depth + 1):
        key = F.concat_ws(">", F.col("_s").cast("string"), F.col("_d").cast("string"))
        step = step.join(e, F.col("last") == F.col("_s")).filter(~F.array_contains("used", key)).select(
            "start", F.col("_d").alias("last"), F.concat("nodes", F.array("_d")).alias("nodes"), F.concat("used", F.array(key)).alias("used"), (F.col("confidence") * F.col("_c")).alias("confidence")
        )
        rows = step.select("start", "nodes", F.lit(d).alias("depth"), "confidence")
        out = rows if out is None else out.unionByName(rows)
    return out


def chains(edges: DataFrame, root: int, depth: int = 3, least: float = 0.3) -> DataFrame:
    """Breadth-first discovery: each node once, at the first depth that reaches it, by the
    smallest parent: parent, node, depth, conf."""
    e = edges.filter(F.col("conf") >= least).select(F.col("src").alias("parent"), F.col("dst").alias("node"), "conf")
    first = e.filter((F.col("parent") == root) & (F.col("node") != root))
    found = top_per_key(first, ["node"], [F.col("parent")], 1).select("parent", "node", F.lit(1).alias("depth"), "conf")
    last = found
    for d in range(2, depth + 1):
        new = e.join(last.select(F.col("node").alias("_n")), F.col("parent") == F.col("_n")).drop("_n")
        new = new.join(found.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti").filter(F.col("node") != root)
        last = stored(top_per_key(new, ["node"], [F.col("parent")], 1).select("parent", "node", F.lit(d).alias("depth"), "conf"))
        found = found.unionByName(last)
    return found


def chain_stats(found: DataFrame) -> DataFrame:
    """By depth: chains, mean and best confidence, and counts by band."""
    c = F.col("conf")
    return found.groupBy("depth").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.max(c), 6).alias("best"),
        F.count_if(c >= 0.7).alias("high"), F.count_if((c >= 0.4) & (c < 0.7)).alias("medium"), F.count_if(c < 0.4).alias("low"),
    )


def spread(edges: DataFrame, start: DataFrame, existing: DataFrame, least: float = 0.1) -> DataFrame:
    """Impact along one or two directed covariation edges (src, dst, rho): weight =
    base x product x 0.5 for targets that have no impact yet; of several paths the
    strongest counts. start: node, base; existing: node."""
    e = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("rho").alias("_r"))
    one = start.join(e, F.col("node") == F.col("_s")).select("node", "base", F.col("_d").alias("target"), F.col("_r").alias("rho"))
    two = one.join(e, F.col("target") == F.col("_s")).filter(F.col("_d") != F.col("node")).select("node", "base", F.col("_d").alias("target"), (F.col("rho") * F.col("_r")).alias("rho"))
    strong = one.unionByName(two).filter((F.abs("rho") > least) & (F.col("target") != F.col("node")))
    fresh = strong.join(existing.select(F.col("node").alias("_n")), F.col("target") == F.col("_n"), "left_anti")
    w = F.col("base") * F.col("rho") * 0.5
    return fresh.groupBy("target").agg(F.max_by(w, F.struct(F.abs(w), w)).alias("weight"))


def similar(events: DataFrame, event_id: int, k: int = 10, least: float = 0.0) -> DataFrame:
    """Events of the same type by the overlap of their companies (array `companies`), 0.5 where neither has any."""
    one = events.filter(F.col("id") == event_id).select(F.col("event_type").alias("_t"), F.col("companies").alias("_c"))
    rest = events.filter(F.col("id") != event_id).join(F.broadcast(one), F.col("event_type") == F.col("_t"))
    sim = F.when((F.size("companies") == 0) & (F.size("_c") == 0), 0.5).otherwise(T.jaccard(F.col("companies"), F.col("_c")))
    return rest.select("id", F.round(sim, 6).alias("similarity")).filter(F.col("similarity") >= least).orderBy(F.col("similarity").desc(), "id").limit(k)


def context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its predecessors and successors, each counted before the join."""
    succ = edges.groupBy(F.col("src").alias("_s")).agg(F.array_sort(F.collect_set("dst")).alias("successors"))
    pred = edges.groupBy(F.col("dst").alias("_d")).agg(F.array_sort(F.collect_set("src")).alias("predecessors"))
    out = nodes.join(succ, F.col("node") == F.col("_s"), "left").join(pred, F.col("node") == F.col("_d"), "left").drop("_s", "_d")
    return out.withColumn("successors", F.coalesce("successors", F.array())).withColumn("predecessors", F.coalesce("predecessors", F.array()))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.col("src").alias("_n")).unionByName(edges.select(F.col("dst").alias("_n")))
    return nodes.join(ends, F.col("node") == F.col("_n"), "left_anti")


def merge_nodes(nodes: DataFrame, edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with one key become the smallest of them; their edges move along, loops and repeats go."""
    keep = nodes.groupBy(key).agg(F.min("node").alias("_keep"))
    to = nodes.join(keep, key).select(F.col("node").alias("_old"), "_keep")
    moved = edges
    for end in ("src", "dst"):
        moved = moved.join(to, F.col(end) == F.col("_old"), "left").withColumn(end, F.coalesce("_keep", end)).drop("_old", "_keep")
    kept = nodes.join(keep.select("_keep"), F.col("node") == F.col("_keep"), "left_semi")
    return kept, moved.filter("src <> dst").dropDuplicates(["src", "dst"])


def upsert_nodes(old: DataFrame, new: DataFrame, key: str, when: str) -> DataFrame:
    """The latest row of each key of both tables."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(when)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def upsert_edges(old: DataFrame, new: DataFrame, when: str) -> DataFrame:
    """The latest edge of each (src, dst, type)."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in ("src", "dst", "type")]
    best = both.groupBy("src", "dst", "type").agg(F.max_by(F.struct(*rest), F.col(when)).alias("_b"))
    return best.select("src", "dst", "type", *[F.col(f"_b.{c}").alias(c) for c in rest])


def clusters(edges: DataFrame) -> DataFrame:
    """(node, cluster): connected components by the smallest node, by repeated minimum and
    pointer jumping; only the number of changes reaches the driver."""
    both = stored(symmetric(edges.select("src", "dst")).distinct())
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.min("src")).alias("cluster")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("_n"), F.col("cluster").alias("_c")), F.col("dst") == F.col("_n")).groupBy("src").agg(F.min("_c").alias("_c"))
        new = labels.join(seen, F.col("node") == F.col("src"), "left").select("node", "cluster", F.least("cluster", "_c").alias("next"))
        jump = labels.select(F.col("node").alias("_n"), F.col("cluster").alias("_j"))
        new = stored(new.join(jump, F.col("next") == F.col("_n"), "left").select("node", "cluster", F.least("next", "_j").alias("next")))
        changed = new.filter("cluster <> next").count()
        labels = new.select("node", F.col("next").alias("cluster"))
        if not changed:
            return labels


def dense_points(pairs: DataFrame, least: int = 2) -> DataFrame:
    """DBSCAN labels from pairs of neighbours (src, dst), both listed once: cores have
    `least` points within reach, themselves included; cores that reach each other share
    a cluster, other points join the smallest cluster among their cores."""
    both = stored(symmetric(pairs.select("src", "dst")).distinct())
    cores = stored(both.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") + 1 >= least).select(F.col("src").alias("core")))
    inner = both.join(cores, F.col("src") == F.col("core"), "left_semi").join(cores, F.col("dst") == F.col("core"), "left_semi")
    return _labels(cores, inner, both.join(cores, F.col("src") == F.col("core"), "left_anti"))


def _labels(cores: DataFrame, inner: DataFrame, outer: DataFrame) -> DataFrame:
    """DBSCAN labels from cores, links between cores that join their clusters, and links (src, dst)
    from other points; those to no core are left out."""
    own = cores.select(F.col("core").alias("node"), F.col("core").alias("self"))
    labelled = own.join(clusters(inner), "node", "left").select("node", F.coalesce("cluster", "self").alias("cluster"))
    edge = outer.join(labelled, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.min("cluster").alias("cluster"))
    return labelled.unionByName(edge)


#: Vectors of a block of one cell, and rows of it that are compared at once.
BLOCK, STRIP = 4096, 256


def _units(rows: pa.Table) -> np.ndarray:
    """Vectors over their length, added up in the order of their numbers."""
    x = rows.column("v").combine_chunks().flatten().to_numpy().astype(float).reshape(rows.num_rows, -1)
    total = np.zeros(len(x))
    for column in x.T:
        total += column * column
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt(total)[:, None]


def _near(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Where the cosine exceeds `least`. Products of matrices add in an order of their own, so
    what lies within their error is added up again as above."""
    with np.errstate(invalid="ignore"):
        dot = x @ y.T
        near = ~(dot <= least)  # NaN is above all, as in SQL
        r, c = np.nonzero(np.abs(dot - least) < 1e-9)
    total = np.zeros(len(r))
    for d in range(x.shape[1] if len(r) else 0):
        total += x[r, d] * y[c, d]
    near[r, c] = total > least
    return near


def _strips(rows: pa.Table, least: float):
    """(numbers of rows, numbers of others, near) of one cell in strips; a block against itself too, without the row itself."""
    i, j, chunk, x = rows.column("_i")[0].as_py(), rows.column("_j")[0].as_py(), rows.column("_chunk").to_numpy(), _units(rows)
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    for k in range(0, len(left), STRIP):
        some = left[k : k + STRIP]
        near = _near(x[some], x[right], least) if len(right) else np.zeros((len(some), 0), bool)
        yield some, right, near & (some[:, None] != right[None, :])


def _degrees(rows: pa.Table, least: float, schema: pa.Schema) -> pa.Table:
    """Neighbours of each row of a cell."""
    n, same = np.zeros(rows.num_rows, np.int64), rows.column("_i")[0] == rows.column("_j")[0]
    for some, right, near in _strips(rows, least):
        n[some] += near.sum(axis=1)
        if not same:
            n[right] += near.sum(axis=0)
    return pa.Table.from_arrays([rows.column("id").combine_chunks(), pa.array(n)], schema=schema).filter(pa.array(n > 0))


def _links(rows: pa.Table, least: float, schema: pa.Schema) -> pa.Table:
    """A spanning forest of a cell's links between cores, and all links from other points to cores."""
    core = rows.column("core").to_numpy(zero_copy_only=False)
    label, out = np.arange(rows.num_rows), []
    for some, right, near in _strips(rows, least):
        for r, row in zip(some, near, strict=True):
            met = right[row]
            if core[r]:
                out += [(x, r) for x in met[~core[met]]]
                trees = np.unique(label[np.append(met[core[met]], r)])
                if len(trees) > 1:
                    out += [(trees[0], t) for t in trees[1:]]
                    label[np.isin(label, trees)] = trees[0]
            else:
                out += [(r, x) for x in met[core[met]]]
    src, dst = np.array(out, np.int64).reshape(-1, 2).T
    ids = rows.column("id").combine_chunks()
    return pa.Table.from_arrays([ids.take(pa.array(src)), ids.take(pa.array(dst)), pa.array(core[src])], schema=schema)


def dense_vectors(vectors: DataFrame, id_col: str, vector: str, block: str, cosine: float, least: int = 2) -> DataFrame:
    """dense_points() of vectors of one block whose cosine exceeds `cosine`, without their pairs.
    An id has one vector; of other lengths than another it is not near it.

    Blocks are cut into chunks, and two chunks meet in a cell as matrices. A first run counts
    neighbours; a second gives each cell's forest between cores, and the links of points that
    are none, of which each has fewer than `least`. So a large group of copies costs its
    comparisons, and rows only as many as its vectors in each cell."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(block).alias("b"), F.col(vector).alias("v")).filter("id is not null and b is not null and forall(v, x -> x is not null)")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    v = v.filter(length > 0).distinct().withColumn("_size", F.size("v"))
    sizes = v.groupBy("b", "_size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_chunks"))
    chunked = stored(v.join(sizes, ["b", "_size"]).withColumn("_chunk", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int")))
    kind = chunked.schema["id"].dataType
    ids = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    ship_package(vectors.sparkSession)

    def in_cells(rows: DataFrame, work, names: str, schema: pa.Schema) -> DataFrame:
        other = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        cells = other.withColumns({"_i": F.least("_chunk", "_other"), "_j": F.greatest("_chunk", "_other")}).drop("_other", "_chunks")
        return stored(cells.groupBy("b", "_size", "_i", "_j").applyInArrow(lambda t: work(t, cosine, schema), names))

    plain = kind.simpleString()
    met = in_cells(chunked, _degrees, f"id {plain}, n long", pa.schema([("id", ids), ("n", pa.int64())]))
    known = stored(met.groupBy("id").agg((F.sum("n") + 1 >= least).alias("core")))
    links = in_cells(chunked.join(known, "id"), _links, f"src {plain}, dst {plain}, inner boolean", pa.schema([("src", ids), ("dst", ids), ("inner", pa.bool_())]))
    return _labels(known.filter("core").select(F.col("id").alias("core")), links.filter("inner"), links.filter("not inner"))
