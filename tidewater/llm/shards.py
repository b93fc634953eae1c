"""Shards by balanced label propagation.

Documents that share a hub (here: equal texts) are linked. Linked documents start in
equal parts, dealt out in the order of their hubs, so few hubs are cut at first (or, to
leave all to the rounds, whatever their hubs). In each round every document of a hub
that is cut counts its neighbours by shard and asks to move to the shard with most of them. Requests from
one shard to another are granted up to a quota: exchange() takes those that pass
documents round in circles, then those that end where room is left, so no shard ever
exceeds its final size and full shards still trade. A shard that is full and that no
document asked to leave is closed to the next round's requests, so a hub too large for
it goes on to the next. Counting goes by (hub, shard), so a hub with any number of
documents sends one row from each task and no pair of neighbours is ever made.
Documents without links fill the shards up to sizes that differ by one row at most
(law `rows`).

Rounds end when nothing is cut or asked for, or when PATIENCE rounds together took less
than GAIN of the links out of the cut. A document with one hub moves only to where more of
the hub is, so then every round helps.

Each round's labels are written to the shared folder. Only numbers for each shard, or
each pair of shards, reach the driver.

Defined results: a null text has no bytes, CRC-32 zero and no links; rows count one
by one, whatever ids repeat or are null; empty texts are equal texts; an empty
table gives no rows; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from collections import deque
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import drop_stored, ranked, salted_join, stored

#: Propagation ends when so many rounds together
PATIENCE = 3
#: took less than this share of the links out of the cut.
GAIN = 0.001
#: Buckets that ranks within a shard are counted by.
BUCKETS = 256
#: Buckets of hubs that the start is dealt out by, each in PARTS parts.
STARTS, PARTS = 4096, 16


def targets(rows: int, shards: int) -> list[int]:
    """Final sizes: at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _fill(ends: list[int]) -> Column:
    """The shard of `rank` if shards are filled one after another up to these ends."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("rank")))


def _bucket(*keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def exchange(asked: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many of the requests asked[from, to] to grant so that no shard gets more
    than it loses and has free: swaps and longer circles first, then chains that end
    in free room."""
    left = {k: n for k, n in sorted(asked.items()) if n > 0 and k[0] != k[1]}
    out: dict[tuple[int, int], int] = {}
    free = list(free)

    def grant(edges: list[tuple[int, int]], n: int) -> None:
        for e in edges:
            out[e] = out.get(e, 0) + n
            left[e] -= n
            if not left[e]:
                del left[e]

    def circle(start: int) -> list[tuple[int, int]] | None:
        """A shortest circle of requests through a shard."""
        came, queue = {start: start}, deque([start])
        while queue:
            a = queue.popleft()
            for b in (y for x, y in left if x == a):
                if b == start:
                    path = [(a, b)]
                    while a != start:
                        path.append((came[a], a))
                        a = came[a]
                    return path
                if b not in came:
                    came[b] = a
                    queue.append(b)
        return None

    for a, b in list(left):
        n = min(left.get((a, b), 0), left.get((b, a), 0))
        if n:
            grant([(a, b), (b, a)], n)
    for start in range(len(free)):
        while path := circle(start):
            grant(path, min(left[e] for e in path))
    moving = True
    while moving:
        moving = False
        for a, b in list(left):
            n = min(left[a, b], free[b])
            if n > 0:
                grant([(a, b)], n)
                free[a], free[b] = free[a] + n, free[b] - n
                moving = True
    return out


def propagate(links: DataFrame, room: list[int], log: list[float] | None = None, by_hub: bool = True) -> DataFrame:
    """(node, shard) for the nodes of links (node, hub): balanced label propagation.

    room: the most nodes that each shard may get; equal parts must fit. `log` gets the
    cut before each round and at the end: for each hub the links that a node has to
    other shards on average, summed. by_hub: whether the start follows the hubs.
    """
    shards, log = len(room), [] if log is None else log
    links = stored(links.distinct(), "hubs")
    nodes = links.groupBy("node").agg(F.min("hub").alias("hub")).withColumn("one", F.lit(0))
    parts = F.pmod(F.xxhash64("hub"), F.lit(STARTS)) * PARTS + F.pmod(F.xxhash64("node"), F.lit(PARTS)) if by_hub else _bucket("node")
    nodes = stored(ranked(nodes, ["one"], parts, [F.col("hub"), F.col("node")] if by_hub else [F.col("node")], "rank").select("node", "rank"), "ranks")
    ends = list(accumulate(targets(nodes.count(), shards)))
    labels = stored(nodes.select("node", (_fill(ends) if by_hub else F.pmod("rank", F.lit(shards))).cast("int").alias("shard")), "labels")
    drop_stored(nodes)
    sizes = _by_shard(labels, shards)
    leaving, turn = [1] * shards, 0
    while True:
        free = [room[s] - sizes[s] for s in range(shards)]
        member = links.join(labels, "node")
        per_shard = member.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        votes = per_shard.groupBy("hub").agg(
            F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("votes"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("squares")
        )
        votes = stored(votes, "votes")
        apart = F.round(1000 * (F.col("all") - F.col("squares") / F.col("all"))).cast("long")
        total = votes.agg(F.coalesce(F.sum(apart), F.lit(0)).alias("cut"), F.coalesce(F.sum("all"), F.lit(0)).alias("links")).first()
        log.append(total.cut / 1000)
        if total.cut == 0 or len(log) > PATIENCE and log[-1 - PATIENCE] - log[-1] < GAIN * total.links:
            drop_stored(votes)
            return labels
        cut_hubs = votes.filter(F.size("votes") > 1).select("hub")
        active = salted_join(member, cut_hubs, "hub", F.col("node")).select("node").distinct()
        open_to = F.array(*[F.lit(free[s] > 0 or leaving[s] > 0) for s in range(shards)])
        heard = salted_join(member.join(active, "node"), votes.select("hub", "votes"), "hub", F.col("node")).groupBy("node", "shard").agg(
            F.min("hub").alias("hub"), F.collect_list("votes").alias("heard")
        )
        count = lambda s: F.aggregate("heard", F.lit(0).cast("long"), lambda acc, m: acc + F.coalesce(F.element_at(m, s), F.lit(0)))
        options = F.transform(
            F.filter(F.array_distinct(F.flatten(F.transform("heard", lambda m: F.map_keys(m)))), lambda s: (s == F.col("shard")) | F.element_at(open_to, s + 1)),
            lambda s: F.struct(count(s).alias("n"), F.xxhash64("hub", s, F.lit(turn)).alias("tie"), s.alias("to")),
        )
        best = heard.withColumn("best", F.array_max(options)).select("node", "hub", "shard", F.col("best.to").alias("to"))
        asked = stored(best.filter("to <> shard"), "asked")
        wanted = {(r.shard, r.to): r.n for r in asked.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}
        drop_stored(votes)
        if not wanted:
            drop_stored(asked)
            return labels
        quota = exchange(wanted, free)
        table = links.sparkSession.createDataFrame([(a, b, n) for (a, b), n in quota.items()], "shard int, to int, quota long")
        queue = ranked(asked.join(F.broadcast(table), ["shard", "to"]), ["shard", "to"], _bucket("hub", F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(16))), [F.col("hub"), F.col("node")], "rank")
        granted = queue.filter("rank < quota").select("node", "to")
        last, labels = labels, stored(labels.join(granted, "node", "left").select("node", F.coalesce("to", "shard").alias("shard")), "labels")
        drop_stored(last)
        drop_stored(asked)
        leaving = [sum(n for (a, _), n in wanted.items() if a == s) - sum(n for (a, _), n in quota.items() if a == s) for s in range(shards)]
        for (a, b), n in quota.items():
            sizes[a], sizes[b] = sizes[a] - n, sizes[b] + n
        turn += 1


def _by_shard(labels: DataFrame, shards: int) -> list[int]:
    sizes = {r.shard: r.n for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [sizes.get(s, 0) for s in range(shards)]


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", log: list[float] | None = None, by_hub: bool = True) -> DataFrame:
    """(id, size, text_crc32, shard, slot, linked) for every row of docs; `log` and `by_hub` as in propagate()."""
    text = F.col(text_col)
    keyed = docs.select(F.monotonically_increasing_id().alias("node"), F.col(id_col).alias("id"), text.alias("text"))
    slim = stored(
        keyed.select(
            "node",
            "id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("crc"),
            F.sha2(F.col("text").cast("binary"), 256).alias("hub"),
        ),
        "rows",
    )
    many = stored(slim.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and hub is not null").select("hub"), "copied")
    linked = salted_join(slim.select("node", "hub"), many, "hub", F.col("node")).select("node", "hub")
    labels = propagate(linked, room := targets(slim.count(), shards), log, by_hub)
    sizes = _by_shard(labels, shards)
    ends = list(accumulate(room[s] - sizes[s] for s in range(shards)))
    both = slim.select("node", "id", "size", "crc").join(labels, "node", "left")
    linked = both.filter("shard is not null").withColumn("linked", F.lit(True))
    alone = ranked(both.filter("shard is null").drop("shard").withColumn("one", F.lit(0)), ["one"], _bucket("node"), [F.col("node")], "rank").drop("one")
    alone = alone.withColumn("shard", _fill(ends)).drop("rank").withColumn("linked", F.lit(False))
    placed = stored(linked.unionByName(alone), "placed")
    return ranked(placed, ["shard"], _bucket("node"), [F.col("node")], "slot").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot", "linked"
    )


def cut(assigned: DataFrame, hub: str, shard: str = "shard") -> DataFrame:
    """(groups, cut_groups, moved_out): groups in several shards, and their rows outside the largest part."""
    parts = assigned.groupBy(hub, shard).agg(F.count(F.lit(1)).alias("n"))
    w = parts.groupBy(hub).agg(F.count(F.lit(1)).alias("parts"), (F.sum("n") - F.max("n")).alias("out"), F.sum("n").alias("all"))
    return w.filter("all > 1").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("parts") > 1).alias("cut_groups"), F.coalesce(F.sum("out"), F.lit(0)).alias("moved_out"))


