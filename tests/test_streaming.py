"""Streams over files run to their end."""

import json

from pyspark.sql import functions as F

from marlstone.sources.shipping import ship
from marlstone.streaming import feed


def test_feed(spark, tmp_path):
    ship(spark)
    rows = [(i, f"k{i % 3}", f"2024-01-01 00:{i:02d}:00", "changed" if i % 4 else "new", '{"k":%d}' % i, "j1", "d") for i in range(20)]
    df = spark.createDataFrame(rows + rows[:5], "seq long, key string, at string, change string, data string, job_id string, dataset string").withColumn("at", F.col("at").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = feed.change_stream(spark, str(tmp_path / "in"), df.schema)
    once = feed.fresh_only(stream, ["seq"], "at")
    q = feed.each_batch(feed.matching(once, {"on": "any", "filters": ["$.k:numgte:10"]}), feed.append_json(str(tmp_path / "out")), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.json(str(tmp_path / "out"))
    assert sorted(r.seq for r in got.collect()) == list(range(10, 20))
    counts = feed.windowed_counts(feed.change_stream(spark, str(tmp_path / "in"), df.schema), "at", ["key"], "10 minutes", "1 minute")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] > 0


def test_cadence(spark, tmp_path):
    ship(spark)
    df = spark.createDataFrame([("a", float(t), t != 30) for t in (0, 10, 30, 40)], "key string, at double, changed boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = feed.cadence_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("cadence").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    r = spark.table("cadence").first()
    assert (r.checks, r.changes, r.last_change) == (4, 3, 40.0) and abs(r.ewma_gap - (0.3 * 30 + 0.7 * 10)) < 1e-9


def test_decisions():
    assert not feed.may_fire(["a"], "a") and not feed.may_fire(list("bcdef"), "a") and feed.may_fire([], "a")
    assert feed.penalty(0, 10, None, False) == (1, 20) and feed.penalty(3, 250, 400, False) == (4, 300) and feed.penalty(1, 10, None, True) == (0, 5)
    assert json.dumps(feed.RETRY_LADDER)
