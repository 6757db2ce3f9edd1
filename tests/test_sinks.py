"""Sinks with state: batches that come again, streams against their finished logs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from listwright.streaming import sinks


def by_hand(rows):
    out = {}
    for k, failed, _ in sorted(rows, key=lambda r: r[2]):
        out[k] = out.get(k, 0) + 1 if failed else 0
    return out


def test_replayed_batches_count_once(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(6)}", rng.random() < 0.7, i) for i in range(120)]
    sink = sinks.FailureCounts(str(tmp_path / "s"), "who", "failed", "n")
    assert sink.read(spark).count() == 0
    frame = lambda part: spark.createDataFrame(part, "who string, failed boolean, n long")
    for i, (a, b) in enumerate(((0, 40), (40, 41), (41, 120))):
        sink(frame(rows[a:b]), i)
        sink(frame(rows[a:b]), i)  # the batch comes again
        assert {r["who"]: r["failures"] for r in sink.read(spark).collect()} == by_hand(rows[:b])
    sink(frame(rows[40:41]), 1)  # and an old one: the newest state stays
    assert {r["who"]: r["failures"] for r in sink.read(spark).collect()} == by_hand(rows)
    sink(frame([(None, True, 1)]), 3)
    assert {r["who"]: r["failures"] for r in sink.read(spark).collect()} == by_hand(rows)


def test_stream_through_the_sink(spark, tmp_path):
    rows = [(f"k{i % 5}", i % 7 > 1, i) for i in range(60)]
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], "who string, failed boolean, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = sinks.FailureCounts(str(tmp_path / "s"), "who", "failed", "n")

    def run():
        stream = spark.readStream.schema("who string, failed boolean, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return {r["who"]: r["failures"] for r in sink.read(spark).collect()}

    assert run() == by_hand(rows) == run()


def test_sessions_of_streams_are_those_of_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"u{rng.randrange(4)}", 1_700_000_000 + rng.randrange(200_000)) for _ in range(200)]
    hits = spark.createDataFrame(rows, "who string, s long").select("who", F.timestamp_seconds("s").alias("ts"))
    hits.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = sinks.sessions(hits, "who", "ts", "1 hour")
    stream = sinks.sessions(spark.readStream.schema(hits.schema).parquet(str(tmp_path / "in")), "who", "ts", "1 hour", "10 minutes")
    query = stream.writeStream.format("memory").queryName("found_sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(map(str, spark.table("found_sessions").collect())) == sorted(map(str, batch.collect()))
    wanted = 0
    for who in {k for k, _ in rows}:
        times = sorted(s for k, s in rows if k == who)
        wanted += 1 + sum(b - a > 3600 for a, b in zip(times, times[1:], strict=False))
    assert batch.count() == wanted
