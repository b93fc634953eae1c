"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.session import shared_folder, ship_package

#: 64-bit words of a bit map of keys: a fixed size, so broadcasting the map is bounded.
MAP_WORDS = 1 << 17
#: Texts handed to Python in one go, in bytes; a single longer text goes alone.
CHUNK_BYTES = 1 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once under the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that ran on it, not
    the steps before the written table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def drop_stored(table: DataFrame) -> None:
    """Delete a table made by stored() that nothing reads any more; others are left alone."""
    spark, at = table.sparkSession, getattr(table, "_stored_at", None)
    if at:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with Arrow batches of CHUNK_BYTES instead of a number of
    rows, so the memory of a Python worker and of the buffers beside the heap doesn't
    depend on the length of texts. The limit is set for the session, as plans run later."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(CHUNK_BYTES))
    return df.mapInArrow(run, schema)


def text_chunks(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each piece have at most `limit` bytes."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)


def ranked(
    df: DataFrame, group: list[str], bucket: Column, order: list[Column], out: str
) -> DataFrame:
    """Gapless ranks from 0 within each group, without one task per group.

    `bucket` is an integer expression with a bounded number of values. Rows are
    ranked within (group, bucket); the counts of the buckets, a table whose size
    doesn't depend on the number of rows, give each bucket its start.
    """
    b = df.withColumn("_bucket", bucket)
    counts = b.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    inner = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)) - 1
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    return (
        b.withColumn("_inner", inner)
        .join(starts, [*on, F.col("_bucket") == F.col("_b")])
        .withColumn(out, (F.col("_start") + F.col("_inner")).cast("long"))
        .drop("_bucket", "_b", "_start", "_inner", *[f"_g{i}" for i in range(len(group))])
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """left joined to right, whose keys are unique, on `key`, with each key's left rows
    dealt over `salts` tasks by `spread`; right is copied that many times."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def bit_map(keys: DataFrame, key: str) -> DataFrame:
    """(_slot, _bits): at most MAP_WORDS rows whose bits are hashes of the keys."""
    h = F.xxhash64(key)
    return keys.select(
        F.pmod(F.shiftrightunsigned(h, 6), F.lit(MAP_WORDS)).alias("_slot"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int")).alias("_bit")
    ).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))


def probe(rows: DataFrame, key: str, marks: DataFrame) -> DataFrame:
    """rows with `_may`: false if the key certainly isn't among those of the bit map."""
    h = F.xxhash64(key)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    found = rows.join(F.broadcast(marks), F.pmod(F.shiftrightunsigned(h, 6), F.lit(MAP_WORDS)) == F.col("_slot"), "left")
    return found.withColumn("_may", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_slot", "_bits")


def without(rows: DataFrame, key: str, bad: DataFrame) -> DataFrame:
    """rows whose key isn't in the one column of `bad`, a stored table; null is a key.

    Rows that the bit map clears stay where they are; only the others are shuffled
    for the exact anti-join, so few bad keys move few rows.
    """
    name = bad.columns[0]
    probed = probe(rows, key, bit_map(bad, name))
    suspects = probed.filter("_may").drop("_may").join(bad.withColumnRenamed(name, "_bad"), F.col(key).eqNullSafe(F.col("_bad")), "left_anti")
    return probed.filter("not _may").drop("_may").unionByName(suspects)
