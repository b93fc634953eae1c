"""URL filters: host and path rules, then a blocked Bloom filter before an exact join.

The filter has blocks of 256 bits: eight words of 32 bits of which a key sets one
bit each. It is built by a grouped OR and kept as a table with at most MAX_BLOCKS
rows, whatever the list's length, so broadcasting it has a proven bound; a list
that overfills it lets more rows through to the exact join and changes no result.
Rows that may be listed meet the distinct list in a shuffled hash join, the others
don't move.

Defined results: a null url or one without :// has an empty host and path, no rule
and isn't listed; null list entries are ignored; repeated rows and repeated list
entries are fine; an empty list lists nothing; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import urls
from tidewater.llm.common import stored

#: Bits of the filter for each listed key, up to MAX_BLOCKS blocks of 256 bits (5 MB as rows).
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 17


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule, as host/path, that fits; null if none does.

    rules: (host/path, verdict). A rule fits its host and the subdomains if the
    path starts with the rule's, which begins at its first slash.
    """
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, rest = rule.partition("/")
        out = F.when(((host == own) | host.endswith("." + own)) & path.startswith("/" + rest), F.lit(rule)).otherwise(out)
    return out


def _address(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and its bits in the block, as four 64-bit masks of two words each."""
    bits = F.xxhash64(F.lit(7), key)
    one = [F.shiftrightunsigned(bits, 5 * i).bitwiseAND(31).cast("int") for i in range(8)]
    shift = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    masks = [shift(one[2 * j]).bitwiseOR(shift(one[2 * j + 1] + 32)) for j in range(4)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)), masks


def build(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w3): the filter of the keys, at most `blocks` rows."""
    block, masks = _address(F.col(key), blocks)
    return listed.select(block.alias("block"), *[m.alias(f"m{j}") for j, m in enumerate(masks)]).groupBy("block").agg(
        *[F.bit_or(f"m{j}").alias(f"w{j}") for j in range(4)]
    )


def blocks_for(keys: int) -> int:
    """A power of two of blocks for so many keys, within the bound."""
    return min(MAX_BLOCKS, 1 << max(0, (keys * BITS_PER_KEY // 256)).bit_length())


def in_list(rows: DataFrame, key: Column, listed: DataFrame, listed_key: Column, out: str = "listed") -> DataFrame:
    """rows with a boolean column that says whether the key is in the list."""
    entries = stored(listed.select(listed_key.alias("_entry")).dropna().distinct(), "listed")
    blocks = blocks_for(entries.count())
    bloom = F.broadcast(build(entries, "_entry", blocks))
    block, masks = _address(F.col("_key"), blocks)
    probed = rows.withColumn("_key", key).join(bloom, block == F.col("block"), "left")
    hit = F.lit(True)
    for j, m in enumerate(masks):
        hit = hit & (F.col(f"w{j}").bitwiseAND(m) == m)
    probed = probed.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("block", "w0", "w1", "w2", "w3")
    exact = entries.withColumn(out, F.lit(True)).hint("shuffle_hash")
    sure = probed.filter("_maybe").join(exact, F.col("_key") == F.col("_entry"), "left").withColumn(out, F.coalesce(out, F.lit(False)))
    sure = sure.drop("_key", "_maybe", "_entry")
    return sure.unionByName(probed.filter("not _maybe").drop("_key", "_maybe").withColumn(out, F.lit(False)))


def judge(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row: the rule's verdict, else block if the
    canonical URL is in `listed` (column canonical_url), else allow."""
    base = pages.select(F.col(id_col).alias("id"), urls.host_of(F.col(url_col)).alias("host"), urls.path_of(F.col(url_col)).alias("path"), urls.canonical(F.col(url_col)).alias("canon"))
    base = base.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    ruled = base.filter("rule is not null").drop("canon").withColumn("listed", F.lit(None).cast("boolean"))
    open_ = base.filter("rule is null")
    looked = in_list(open_, F.col("canon"), listed, F.col("canonical_url")).drop("canon")
    verdict = F.when(F.col("listed"), "block").otherwise("allow")
    for rule, says in rules:
        verdict = F.when(F.col("rule") == rule, says).otherwise(verdict)
    return ruled.unionByName(looked).select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
