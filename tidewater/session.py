"""Session factory used by the bench, the tests and ad-hoc work."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: int | None = None, app: str = "tidewater", **conf: str) -> SparkSession:
    """A local session with UTC, AQE and shuffle partitions sized to the cores.

    On a cluster the session comes from spark-submit; nothing in the library
    depends on this factory.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEWATER_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset, a local session (tests, a laptop) gets a temporary folder,
    removed at exit; on a cluster, where a folder of one machine would lose rows, this
    is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    own = getattr(context, "_tidewater_folder", None)
    if own is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = context._tidewater_folder = tempfile.mkdtemp(prefix="tidewater-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once under the shared folder and read back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Partitions from which a scan is left as it is split.
SPLIT = 8


def spread(df: DataFrame) -> DataFrame:
    """df, a scan, dealt over the cores if it comes in a handful of partitions, as a small
    file of one row group does. A scan of SPLIT or more partitions isn't moved."""
    n = min(SPLIT, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: it is added to the
    session's Python files once, as a zip that the driver serves."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_tidewater_shipped", False) or not os.path.isdir(root):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidewater-"), "tidewater.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._tidewater_shipped = True
