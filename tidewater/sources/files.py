"""Readers and writers of files, tables and dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEWS = "text string, title string, timestamp long, date string, url string, source string"


def read_news_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of news; the time is timestamp, else date, else empty."""
    raw = spark.read.schema(NEWS).option("multiLine", True).json(path)
    return raw.withColumn("time", F.coalesce(F.col("timestamp").cast("string"), "date", F.lit("")))


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A JDBC table, read in parallel ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def read_listing(df: DataFrame, payload: str) -> DataFrame:
    """Exchange answers, JSON with columns and data, as one map per row; kept with an ISIN or if traded."""
    shape = "columns array<string>, data array<array<string>>"
    rows = df.select(F.from_json(payload, shape).alias("j")).select("j.columns", F.explode("j.data").alias("row"))
    m = rows.select(F.map_from_arrays("columns", "row").alias("m"))
    return m.filter((F.coalesce(F.col("m")["isin"], F.lit("")) != "") | (F.col("m")["is_traded"] == "1"))


def read_graph(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """A graph dump as JSON lines or CSV; CSV values become null, booleans or numbers where they can."""
    if fmt == "json":
        return spark.read.json(path)
    return spark.read.option("header", True).option("inferSchema", True).option("nullValue", "").csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str) -> None:
    """nodes and edges folders; in CSV labels are joined by bars."""
    if fmt == "csv":
        flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in nodes.dtypes]
        nodes.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
        edges.write.mode("overwrite").option("header", True).csv(f"{path}/edges")
    else:
        nodes.write.mode("overwrite").json(f"{path}/nodes")
        edges.write.mode("overwrite").json(f"{path}/edges")


def cypher(nodes: DataFrame, label: str, key: str) -> DataFrame:
    """One MERGE statement per node."""
    props = F.to_json(F.struct(*[c for c in nodes.columns]))
    return nodes.select(F.concat(F.lit(f"MERGE (n:{label} {{{key}: '"), F.replace(F.col(key).cast("string"), F.lit("'"), F.lit("\\'")), F.lit("'}) SET n += "), F.regexp_replace(props, '"([A-Za-z_]+)":', "$1:"), F.lit(";")).alias("statement"))


def write_partitioned(df: DataFrame, path: str, day: str, mode: str = "append") -> None:
    """Parquet by day, one sorted run per day and task, so day filters prune folders."""
    df.repartition(day).sortWithinPartitions(day).write.mode(mode).partitionBy(day).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table bucketed by a join key, so joins on it don't shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
