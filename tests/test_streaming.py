"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from palimpsest.operators import state
from palimpsest.sources.tables import table
from palimpsest.streaming import state as streams


def run(spark, sf, tmp_path, make, mode):
    source = tmp_path / "in"
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    name = f"out_{make.__name__}" if hasattr(make, "__name__") else "out"
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name), events


def test_latest_wins(spark, sf, tmp_path):
    got, events = run(spark, sf, tmp_path, streams.latest_wins_stream, "update")
    last = {r["user_id"]: r["event_id"] for r in state.latest_wins(got, "user_id", "ts", "event_id", ["event_id", "ts"]).collect()}
    want = {r["user_id"]: r["event_id"] for r in state.latest_wins(events, "user_id", "ts", "event_id", ["event_id", "ts"]).collect()}
    assert last == want


def test_quota(spark, sf, tmp_path):
    def quota(s):
        return streams.quota_stream(s, 3)

    got, events = run(spark, sf, tmp_path, quota, "append")
    rows = got.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("granted").cast("int")).alias("g")).collect()
    assert rows and all(r["g"] == min(3, r["n"]) for r in rows) and sum(r["n"] for r in rows) == events.count()


def test_latest_wins_last_row_out_is_the_newest(spark, sf, tmp_path):
    def newest(s):
        return streams.latest_wins_stream(s)

    got, events = run(spark, sf, tmp_path, newest, "update")
    last = {r["user_id"]: r["event_id"] for r in got.collect()}  # the sink keeps rows in the order in which they came
    want = {r["user_id"]: r["event_id"] for r in state.latest_wins(events, "user_id", "ts", "event_id", ["event_id", "ts"]).collect()}
    assert last == want


def test_windowed_counts(spark, sf, tmp_path):
    def counts(s):
        return streams.windowed_counts(s, late="3650 days")

    got, events = run(spark, sf, tmp_path, counts, "update")
    out = {(r["start"], r["event_type"]): r["n"] for r in got.collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in streams.windowed_counts(events).collect()}
    assert out == want
