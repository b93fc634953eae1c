"""A stream over files equals the batch."""

import pytest

from tidewater.streaming import streams

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def stream(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    return streams.event_time(streams.read_files(spark, str(tmp_path / "in"), EVENTS, per_trigger=1), "ts")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("width,slide", [("1 day", None), ("6 hours", "1 hour")])
def test_windows(spark, sf_dir, stream, width, slide):
    name = f"w{width[0]}"
    streams.to_memory(streams.windowed(stream, "ts", width, slide), name)
    batch = streams.windowed(streams.event_time(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts"), "ts", width, slide)
    assert rows(spark.table(name)) == rows(batch)


def test_sessions(spark, sf_dir, stream):
    streams.to_memory(streams.sessions(stream, "ts", "1 hour"), "sess")
    batch = streams.sessions(streams.event_time(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts"), "ts", "1 hour")
    assert rows(spark.table("sess")) == rows(batch)


def test_deduplication_and_idempotent_sink(spark, stream, tmp_path):
    twice = stream.union(stream)
    out = str(tmp_path / "out")

    def merge(batch, epoch):
        batch.select("event_id").write.mode("overwrite").parquet(f"{out}/{epoch}")

    streams.upsert_sink(streams.deduplicated(twice, ["event_id"]), merge, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(out)
    assert got.count() == got.distinct().count() == 1000


def test_late_causes_meet_history(spark, stream, tmp_path):
    e = stream.selectExpr("event_id as id", "ts", "user_id % 20 as k", "event_type").filter("event_type = 'error'")
    history = spark.read.parquet(str(tmp_path / "in")).selectExpr("event_id as id", "cast(ts as timestamp) ts", "user_id % 20 as k")
    streams.to_memory(streams.retro_links(e, history, ["k"], 1), "late", "append")
    batch = streams.retro_links(history.join(spark.read.parquet(str(tmp_path / "in")).filter("event_type = 'error'").selectExpr("event_id as id"), "id", "left_semi"), history, ["k"], 1)
    assert rows(spark.table("late")) == rows(batch) and batch.count() > 0
